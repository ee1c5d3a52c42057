"""The driver tables seen as river-model data: a DataFrame and a SQL form of each view."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.sums import steady_sum

DIGITS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: the checkpoint folder where it is set, else the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def nudge(digits: int) -> float:
    return float(f"3.1e-{digits + 4}")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded for comparison.

    A nudge far below the last digit keeps values that sit exactly between two roundings
    (means of two-decimal prices do) on the same side everywhere; + 0.0 turns -0.0 into 0.0.
    """
    return df.select(*[
        (F.round(F.col(c.name) + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(c.name) if c.dataType.typeName() == "double" else F.col(c.name)
        for c in df.schema])


def rsql(sql: str, ctes: str = "", doubles: str = "", others: str = "", digits: int = DIGITS) -> str:
    """Wrap a SQL body: named doubles rounded, other columns as they are."""
    cols = others.split() + [f"round({d} + {nudge(digits)!r}::DOUBLE, {digits}) + 0.0 AS {d}" for d in doubles.split()]
    head = f"WITH {with_ctes(ctes)}" if ctes else ""
    return f"{head} SELECT {', '.join(cols)} FROM ({sql}) AS body"


def with_ctes(names: str) -> str:
    return ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())


# sums of one line item group: price p, quantity q and their products with discount and tax
_SUMS = {
    "p": "l_extendedprice", "q": "l_quantity", "pd": "l_extendedprice * l_discount", "pt": "l_extendedprice * l_tax",
    "qd": "l_quantity * l_discount", "qt": "l_quantity * l_tax",
}
_REACH = {
    "load_kg": "p", "flow_cms": "q", "sed_in": "p - pd", "sed_out": "p + pt", "orgn_in": "pd", "orgn_out": "pt",
    "nh4_in": "qd", "nh4_out": "qt", "no3_in": "q", "no3_out": "q * 0.5", "no2_in": "qd * 0.5", "no2_out": "qt * 0.5",
    "orgp_in": "pd * 0.25", "orgp_out": "pt * 0.25", "minp_in": "q * 0.125", "minp_out": "q * 0.25",
    "tot_n": "pt + q", "tot_p": "pt * 0.25 + q",
}
_SUB = {
    "area_km2": "sub + cast(5 as double)", "wyld": "q * 0.5", "syld": "p * 0.001", "orgn": "pd * 0.01", "orgp": "pt * 0.01",
    "solp": "qd", "sedp": "qt", "nsurq": "qd * 0.5",
}
_sum_list = ", ".join(f"sum({e}) AS {n}" for n, e in _SUMS.items())
_as = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())

SQL: dict[str, str] = {
    "sim": f"""
        SELECT run_id, rch, date, {_as(_REACH)} FROM (
          SELECT CAST(l_linenumber AS VARCHAR) AS run_id, CAST(l_suppkey % 17 + 1 AS INTEGER) AS rch,
                 CAST(l_shipdate AS DATE) AS date, {_sum_list}
          FROM lineitem GROUP BY 1, 2, 3)""",
    "sub": f"""
        SELECT sub, date, {_as(_SUB)} FROM (
          SELECT CAST(l_suppkey % 17 + 1 AS INTEGER) AS sub, CAST(l_shipdate AS DATE) AS date, {_sum_list}
          FROM lineitem GROUP BY 1, 2)""",
    "measured": """
        SELECT o_orderpriority AS station, o_orderstatus AS analyte, o_orderdate AS date,
               CASE WHEN o_totalprice >= 15000 AND o_totalprice < 20000 THEN 'LC'
                    ELSE CAST((o_totalprice - 15000) / 1000 AS VARCHAR) END AS value
        FROM orders""",
    "flow": "SELECT l_shipdate AS date, l_quantity * 1000 AS flow_m3d FROM lineitem",
    "gauge": "SELECT event_id, ts, value AS q FROM events",
    "gauges": "SELECT event_id, event_type AS station, ts, value AS q FROM events",
}
# views built on the ones above
SQL["cleaned"] = """
        SELECT station, analyte, CAST(date AS DATE) AS date, date AS ts, TRY_CAST(value AS DOUBLE) AS v FROM measured"""
SQL["daily"] = """
        SELECT station, analyte, date, avg(CASE WHEN v < 0 THEN 0.0 ELSE v END) AS obs FROM cleaned GROUP BY 1, 2, 3"""
SQL["reach_load"] = """
        SELECT run_id, rch, date, unnest(['load', 'tot_n']) AS variable, unnest([load_kg / 1000, tot_n]) AS v FROM sim"""
SQL["q3"] = """
        SELECT rch, variable, date, min(v) AS min, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.25) AS p25,
               quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90,
               quantile_cont(v, 0.95) AS p95, max(v) AS max, avg(v) AS mean, count(v) AS n_values
        FROM reach_load GROUP BY 1, 2, 3"""
SQL["samples"] = """
        SELECT o_orderpriority || '/' || (o_custkey % 17 + 1)::VARCHAR AS station, o_orderstatus AS analyte, o_orderdate AS date,
               CASE WHEN o_totalprice >= 15000 AND o_totalprice < 20000 THEN 'LC'
                    ELSE CAST((o_totalprice - 15000) / 1000 AS VARCHAR) END AS value
        FROM orders"""
SQL["stations"] = "SELECT DISTINCT o_orderpriority || '/' || (o_custkey % 17 + 1)::VARCHAR AS station, o_orderstatus AS analyte, CAST(o_custkey % 17 + 1 AS INTEGER) AS rch FROM orders"
SQL["sites"] = """
        SELECT station, rch, variable, analyte FROM stations JOIN (VALUES ('load', 'F'), ('load', 'O'), ('tot_n', 'P'), ('tot_n', 'F')) t(variable, analyte) USING (analyte)"""
SQL["sited"] = """
        SELECT rch, variable, d.station AS station, d.analyte AS analyte, date, obs FROM (
          SELECT station, analyte, CAST(date AS DATE) AS date, avg(CASE WHEN v < 0 THEN 0.0 ELSE v END) AS obs FROM (
            SELECT *, TRY_CAST(value AS DOUBLE) AS v FROM samples) GROUP BY 1, 2, 3) d
        JOIN sites ON sites.station = d.station AND sites.analyte = d.analyte"""
SQL["flow_day"] = "SELECT CAST(date AS DATE) AS date, sum(flow_m3d) AS flow_m3d FROM flow GROUP BY 1"


def _base(spark: SparkSession, sf_dir: str, keys: dict[str, str], derived: dict[str, str]) -> DataFrame:
    # read several times by one plan, so that these must be the same each time
    sums = [steady_sum(F.expr(e)).alias(n) for n, e in _SUMS.items()]
    g = table(spark, sf_dir, "lineitem").groupBy(*[F.expr(e).alias(k) for k, e in keys.items()]).agg(*sums)
    return g.select(*keys, *[F.expr(e).cast("double").alias(n) for n, e in derived.items()])


def sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reach output of an ensemble: one row per run, reach and day."""
    return _base(spark, sf_dir, {
        "run_id": "cast(l_linenumber as string)", "rch": "cast(l_suppkey % 17 + 1 as int)",
        "date": "cast(l_shipdate as date)"}, _REACH)


def sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-basin output: one row per sub-basin and day."""
    return _base(spark, sf_dir, {"sub": "cast(l_suppkey % 17 + 1 as int)", "date": "cast(l_shipdate as date)"}, _SUB)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab samples: text values, some below detection (LC) and some negative."""
    x = F.col("o_totalprice")
    lc = (x >= 15000) & (x < 20000)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("station"), F.col("o_orderstatus").alias("analyte"),
        F.col("o_orderdate").alias("date"),
        F.when(lc, "LC").otherwise(((x - 15000) / 1000).cast("string")).alias("value"))


def _station() -> Column:
    return F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 17 + 1).cast("string"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lab samples under the names of their sampling points, 85 in number."""
    x = F.col("o_totalprice")
    lc = (x >= 15000) & (x < 20000)
    return table(spark, sf_dir, "orders").select(
        _station().alias("station"), F.col("o_orderstatus").alias("analyte"), F.col("o_orderdate").alias("date"),
        F.when(lc, "LC").otherwise(((x - 15000) / 1000).cast("string")).alias("value"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analytes and the reach of each sampling point."""
    return table(spark, sf_dir, "orders").select(_station().alias("station"), F.col("o_orderstatus").alias("analyte"), (F.col("o_custkey") % 17 + 1).cast("int").alias("rch")).distinct()


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge flow, several rows per day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("date"), (F.col("l_quantity") * 1000).alias("flow_m3d"))


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular high-frequency record."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("value").alias("q"))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular records of several gauges."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("station"), "ts", F.col("value").alias("q"))
