"""Compare every registered query with its SQL on DuckDB.

python tests/oracle.py [name-part ...]   (SF_DIR picks the tables)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x) for x in r) if all(not isinstance(x, float) for x in r)
             else tuple((x is None, "" if isinstance(x, float) else str(type(x)), x if x is not None else 0) for x in r))
    return [columns[i] for i in order], out


def compare(con, df, sql):
    """Returns (ok, message)."""
    c1, r1 = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    types = {x[0]: str(x[1]) for x in cur.description}
    c2, r2 = rows_of([x[0] for x in cur.description], cur.fetchall())
    if c1 != c2:
        return False, f"columns {c1} vs {c2}"
    if len(r1) != len(r2):
        return False, f"rows {len(r1)} vs {len(r2)}"
    alias = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    odd = [(f.name, f.dataType.typeName(), types[f.name]) for f in df.schema
           if alias.get(f.dataType.typeName()) != types[f.name].replace("STRING", "VARCHAR")]
    note = f" types {odd}" if odd else ""
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        near = sum(all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5))
                       for x, y in zip(a, b)) for a, b in bad)
        return False, f"{len(bad)} of {len(r1)} rows differ ({near} nearly equal), columns {c1}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}{note}"
    return True, f"{len(r1)} rows{note}"


def main() -> int:
    from freshet.session import get_spark

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark()
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    parts = sys.argv[1:]
    failed = []
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            if name in sqls:
                ok, msg = compare(con, fn(spark, sf_dir), sqls[name])
            else:
                ok, msg = True, f"{len(fn(spark, sf_dir).collect())} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(("ok  " if ok else "BAD ") + f"{name} [{time.time() - t:.1f}s] {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    code = main()
    sys.stdout.flush()
    os._exit(code)
