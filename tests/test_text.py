"""Text files written to disk and read back, cut into many splits."""

import datetime as dt
import json
import math

import pytest
from oracle import compare as compare_with_sql
from oracle import connect
from pyspark.sql import functions as F

from freshet.operators import compare, ledger, select
from freshet.plans.catalog import catalog
from freshet.sources import sinks, tables, text

CIO = ["title", "", "               5    | NBYR : years", "            1981    | IYR : year", "               1    | IDAF : day", "               5    | NYSKIP : skip", "  99 | NYSKIP later"]


def run_folder(root, name, days=3, reaches=17, bad=None):
    f = root / name
    f.mkdir(parents=True)
    lines = [f"head {i}" for i in range(9)]
    for d in range(days):
        for r in range(1, reaches + 1):
            cells = ["REACH", str(r), "0", str(d), "12.5"] + [str(d * 100 + r + i / 10) for i in range(58)]
            if bad == (d, r):
                cells[6] = "****"
            lines.append("  ".join(cells))
    (f / "output.rch").write_text("\n".join(lines) + "\n")
    (f / "file.cio").write_text("\n".join(CIO) + "\n")
    return f


@pytest.fixture()
def small_splits(spark):
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_reach_runs_over_many_splits(spark, tmp_path, small_splits):
    run_folder(tmp_path, "real1/out_a", days=20)
    run_folder(tmp_path, "real2/out_b", days=3, bad=(1, 5))
    df = text.read_reach_runs(spark, f"{tmp_path}/*/out_*")
    assert text.read_lines(spark, f"{tmp_path}/real1/out_a/output.rch").rdd.getNumPartitions() > 5
    rows = df.collect()
    assert len(rows) == 17 * 23 and {r["run_id"] for r in rows} == {"rch_out_a", "rch_out_b"}
    for r in rows:
        day = (r["date"] - dt.date(1986, 1, 1)).days
        assert r["FLOW_INcms"] == day * 100 + r["RCH"] and r["area_ha"] == 1250.0
    bad = [r for r in rows if r["FLOW_OUTcms"] is None]
    assert [(r["run_id"], r["date"], r["RCH"]) for r in bad] == [("rch_out_b", dt.date(1986, 1, 2), 5)]
    assert "GIS" not in df.columns and "EC" in df.columns and len(text.REACH_FIELDS) == 63


def test_line_numbers_follow_the_file(spark, tmp_path, small_splits):
    f = tmp_path / "x.txt"
    f.write_text("\n".join(f"line {i}" for i in range(1, 1001)) + "\n")
    assert text.read_lines(spark, str(f)).where(F.concat(F.lit("line "), F.col("line_no").cast("string")) != F.col("value")).count() == 0


def test_names_and_checks(spark, tmp_path):
    run_folder(tmp_path, "real1/out_a")
    assert text.read_reach_runs(spark, f"{tmp_path}/real1/out_a", name_from="parent", prefix="x_").first()["run_id"] == "x_real1"
    run_folder(tmp_path, "plain")
    with pytest.raises(Exception, match="out_"):
        text.read_reach_runs(spark, f"{tmp_path}/plain").collect()
    with pytest.raises(ValueError):
        text.with_dates(spark.createDataFrame([], "file_path string, line_no long, value string"), None, 0)


def test_control_file(spark, tmp_path):
    run_folder(tmp_path, "out_a")
    r = text.control_values(text.read_lines(spark, f"{tmp_path}/out_a/file.cio")).first()
    assert (r["start_date"], r["start_year"], r["end_year"]) == (dt.date(1986, 1, 1), 1986, 1990)


def test_sub_fixed_width(spark, tmp_path):
    f = run_folder(tmp_path, "out_a")
    line = "BIGSUB " + f"{3:4d}" + f"{0:9d}" + f"{1.9:5.1f}" + " " + f"{10.5:9.3f}" + "".join(f"{i + 0.25:10.3f}" for i in range(13)) + " " * 10 + "   ****   "
    (f / "output.sub").write_text("\n".join(["h"] * 9 + [line] * 20) + "\n")
    rows = text.read_sub_runs(spark, str(f)).orderBy("date").collect()
    assert rows[0]["SUB"] == 3 and rows[0]["MON"] == 1 and rows[0]["area_ha"] == 1050.0
    assert rows[0]["PRECIP"] == 0.25 and rows[0]["SOLP"] == 0.0 and rows[0]["SEDP"] == 0.0
    assert [r["date"].day for r in rows] == [1] * 17 + [2] * 3


def test_attribute_csv(spark, tmp_path):
    f = tmp_path / "hru.csv"
    f.write_text('HRU_GIS;name;a;b;c\n"123,0";x;"1,5";"2,25";oops\n7;y;;3;"1e1"\n')
    df = tables.read_attributes(spark, str(f), "HRU_GIS", ["a"])
    assert [tuple(r) for r in df.orderBy("HRU_GIS").collect()] == [(7, "y", None, 3.0, 10.0), (123, "x", 1.5, 2.25, None)]
    with pytest.raises(KeyError):
        tables.read_attributes(spark, str(f), "HRU_GIS", ["nitrogen"])


def test_samples_flow_and_fingerprint(spark, tmp_path):
    (tmp_path / "s.csv").write_text("F_MUESTREO,est_estaci,NOMBRE,RESULTADO\n2020-01-02 10:00:00,30304,FOSFORO TOTAL,LC\n")
    r = tables.read_samples(spark, str(tmp_path / "s.csv")).first()
    assert (r["station"], r["value"], r["date"]) == ("30304", "LC", dt.datetime(2020, 1, 2, 10))
    (tmp_path / "q.csv").write_text("date,q\n2020-01-02,5\n2020-01-02,x\n")
    assert [x["flow_m3d"] for x in tables.read_flow(spark, str(tmp_path / "q.csv"), "q").collect()] == [5.0, None]
    import hashlib
    r = tables.fingerprints(spark, str(tmp_path / "q.csv"), kind="csv").first()
    assert r["sha256"] == hashlib.sha256((tmp_path / "q.csv").read_bytes()).hexdigest() and r["kind"] == "csv" and r["size"] == 33
    assert tables.upstream_files(spark, str(tmp_path), "q*.csv", ["zones.shp"]).count() == 2
    assert tables.fingerprints(spark, str(tmp_path / "q.csv"), False).first()["sha256"] is None


def test_filters_reach_the_scan(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 17).cast("int").alias("rch"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                 F.lit("r").alias("run_id"), F.lit(1).alias("run_no"), F.rand().alias("v"), F.rand().alias("unused"))
    tables.write_runs(df, str(tmp_path / "runs"))
    runs = tables.read_runs(spark, str(tmp_path / "runs"), later_wins=False)
    out = select.time_slice(select.reach(runs, 3, ["run_id", "date", "v"]), "2020-01-05", "2020-03-01")
    scan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(rch,3)" in scan and "GreaterThanOrEqual(date,2020-01-05)" in scan
    assert "unused" not in scan.split("ReadSchema")[1]


def test_run_dataset(spark, tmp_path):
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(1, "a", 1, d, 1.0), (2, "a", 1, d, 2.0), (3, "b", 1, d, 3.0)], "run_no int, run_id string, rch int, date date, v double")
    tables.write_runs(df, str(tmp_path / "runs"))
    got = tables.read_runs(spark, str(tmp_path / "runs"), [1, 2])
    assert [(r["run_no"], r["v"]) for r in got.collect()] == [(2, 2.0)]
    assert tables.read_runs(spark, str(tmp_path / "runs"), later_wins=False).count() == 3
    plan = tables.read_runs(spark, str(tmp_path / "runs"), [1, 2], False)._jdf.queryExecution().executedPlan().toString()
    assert "run_no" in plan.split("PartitionFilters: [")[1].split("]")[0]  # folders of other runs are not read


RECORD = {"schema_version": "1", "id": 1, "run_id": 4, "name": "n", "created_at": "2024-01-01T00:00:00+00:00", "engine": {"module": "m", "run_id": 4},
          "inputs": [{"path": "/a/x.TIF", "size": 1}, {"path": "/a/y.csv"}], "status": "success",
          "steps": [{"name": "transform_scale_variable", "args": {"src": "p", "out": "q", "lower": 0.5, "upper": 1.5}, "started_at": "2024-01-01T00:00:05Z", "ended_at": "2024-01-01T00:00:02Z"},
                    {"name": "scale_choices", "args": {"src": "p", "out": "q", "factor": 0.9, "source": "random", "lower": 9, "upper": 9}},
                    {"name": "split_choices", "args": {"src": "q", "renormalize": False, "outputs": [{"name": "z", "ratio": 0.3, "lower": 0.1, "upper": 0.4, "source": "override"}]}},
                    {"name": "point_mgL_choices", "args": {"mgL_values": {"NO3YR": {"mgL": 20, "lower": 1, "upper": 30, "source": "standard"}}}},
                    {"name": "transform_apply_ops", "args": {"ops": []}, "started_at": "2024-01-01T00:00:00Z", "ended_at": "2024-01-01T00:00:10Z"}]}


def test_ledger_file(spark, tmp_path):
    second = {"id": 2, "engine": {"run_id": 4}, "steps": [], "inputs": [{"path": "/a/y.csv"}]}
    odd = {"id": 3, "steps": [{"name": "scale_choices", "args": {"src": "p", "out": "w", "factor": "high", "source": "x"}}]}
    (tmp_path / "odd.jsonl").write_text(json.dumps(odd) + "\n" + json.dumps(RECORD)[:60] + "\n")
    for typed in (False, True):
        one = ledger.choices(tables.read_ledger(spark, str(tmp_path / "odd.jsonl"), typed)).collect()
        assert [(r["id"], r["out"], r["value"]) for r in one] == [(3, "w", None)]
    (tmp_path / "l.jsonl").write_text(json.dumps(RECORD) + "\n\n{broken\n" + json.dumps(second) + "\n   \n")
    led = tables.read_ledger(spark, str(tmp_path / "l.jsonl"))
    assert sorted(r["id"] for r in led.collect()) == [1, 2]
    s = ledger.summary(led).first()
    assert (s["n_records"], s["n_runs"], s["engine_variants"], s["n_inputs"]) == (2, 1, 2, 2)
    assert (s["duration_avg"], s["duration_max"]) == (10.0, 10.0)  # the step that ends before it starts does not count
    rows = {r["transform"]: r for r in ledger.choices(led).collect()}
    typed = tables.read_ledger(spark, str(tmp_path / "l.jsonl"), True)
    assert sorted(map(str, ledger.choices(typed).collect())) == sorted(map(str, ledger.choices(led).collect()))
    assert (rows["scale_variable"]["lower"], rows["scale_variable"]["upper"], rows["scale_variable"]["value"]) == (0.5, 1.5, 0.9)
    assert (rows["split_with_bounds"]["lower"], rows["split_with_bounds"]["renorm"]) == (0.1, False)
    assert rows["mgL_point"]["out"] == "NO3YR" and rows["mgL_point"]["value"] == 20.0
    assert [r["n_realizations"] for r in ledger.run_summary(led).collect()] == [2]
    assert [r["path"] for r in ledger.unique_inputs(led, rasters_only=True).collect()] == ["/a/x.TIF"]
    plan = ledger.replay_plan(led, [1]).orderBy("step_no").collect()
    assert [(r["step"], json.loads(r["args"])) for r in plan] == [("transform_apply_ops", {"ops": []})]
    assert {(r["target"], r["sources"]) for r in ledger.run_targets(led).collect()} == {("q", "random"), ("z", "override"), ("NO3YR", "standard")}
    assert ledger.realization(led, 2).count() == 0


def test_ledger_append_and_read_back(spark, tmp_path):
    runs = spark.createDataFrame([(7, 3, "r7", None), (8, 3, "r8", "boom")], "id long, run_id long, name string, error string")
    for _ in range(2):
        sinks.append_ledger(sinks.ledger_records(runs), str(tmp_path / "led"), str(tmp_path / "copies"))
    assert spark.read.json(str(tmp_path / "copies" / "realization=r7")).count() == 2
    back = tables.read_ledger(spark, str(tmp_path / "led"))
    assert sorted((r["id"], r["status"]) for r in back.collect()) == [(7, "success")] * 2 + [(8, "failed")] * 2


def test_soil_file_lines(spark):
    base = [" Soil NO3 [mg/kg]   :        1.00   2.00", " Soil labile P      :  7", "no colon Soil", " Empty NO3 :   ", "Phosphorus perc coef :  10.00"]
    lines = spark.createDataFrame([(5, i, v) for i, v in enumerate(base)] + [(6, 0, "x")], "hru_id int, line_no int, value string")
    repl = spark.createDataFrame([(1, 5, "Soil NO3", 3.456), (1, 5, "Soil labile P", 1234.5), (1, 5, "Empty NO3", 1.0), (1, 99, "Soil NO3", 1.0)], "run_no int, hru_id int, label string, value double")
    out = [r for r in sinks.soil_file_lines(lines, repl, 0.5).orderBy("line_no").collect()]
    assert {r["file_name"] for r in out} == {"000000005.chm"}
    assert [r["line"] for r in out] == [" Soil NO3 [mg/kg]   :        3.46   2.00", " Soil labile P      :1234.50", "no colon Soil", " Empty NO3 :   ", "Phosphorus perc coef :   0.50"]
    kept = sinks.soil_file_lines(lines, repl).where("line_no = 4").first()["line"]
    assert kept == base[4]


def test_point_file_lines_and_csv(spark, tmp_path):
    loads = spark.createDataFrame([(1, 3, y, y / 7.0, 0.0) for y in (2001, 2000, 2005)], "run_no int, zone_id int, YEAR int, FLOYR double, NO3YR double")
    out = [r["line"] for r in sinks.point_file_lines(loads, start=2000, end=2001).orderBy("line_no").collect()]
    assert len(out) == 8 and out[0] == " TITLE LINE 1 - Subbasin ID 3 | Simulation Years: 2000-2001 | DRAINAGE_AREA (km²): 0.000"
    assert out[5] == " YEAR" + "FLOYR".rjust(17) + "NO3YR".rjust(17)
    assert out[6] == f"{2000:5d} " + f"{2000 / 7:.10E}".rjust(16) + " " + f"{0.0:.10E}".rjust(16)
    sinks.write_zone_csv(loads.coalesce(1), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).count() == 3
    sinks.write_lines(sinks.point_file_lines(loads), str(tmp_path / "lines"))
    assert spark.read.parquet(str(tmp_path / "lines")).where("run_no = 1").count() == 9


def test_most_decimals_hold_for_zero(spark):
    """A short exponent leaves room for a tenth decimal, which a column of nine decimals must not take."""
    row = spark.range(1).select(sinks.scientific16(F.lit(0.0)).alias("ten"), sinks.scientific16(F.lit(0.0), 9).alias("nine"), sinks.scientific16(F.lit(-2.5e-120), 9).alias("eight")).first()
    assert tuple(row) == ("0.0000000000E+00", " 0.000000000E+00", "-2.50000000E-120")


def c_form(x, most=10):
    """The reference's text of a number."""
    forms = [f"{x:.{n}E}" for n in range(most, -1, -1)]
    return next(f for f in forms if len(f) <= 16).rjust(16)


def test_scientific_text_rounds_the_double(spark):
    """Doubles beside or on the middle of two results: one of the file of zone 4, neighbours of halves, whole halves, and halves with a point."""
    values = [750985.662515, 65.3244781695, -65.3244781695, 4.24392848745e44, -4.24392848745e-44, 9.99999999995e99, 1e-200, -0.0, 0.1]
    values += [float(x) for x in (282637390005, 282637390015, -3015714664500, 95028703294500, 95028703294501, 95028703294499, 2**62, 1234567890150000000 - 256)]
    values += [(2826373900050 + k) / 2**10 for k in range(20)] + [-(x + 0.5) for x in (28263739000, 28263739001)]
    values += [math.nextafter(x, to) for x in (282637390005.0, 65.3244781695, 3.015714664515e18) for to in (0, math.inf)]
    df = spark.createDataFrame([(x,) for x in values], "v double").select("v", sinks.scientific16(F.col("v")).alias("ten"), sinks.scientific16(F.col("v"), 9).alias("nine"))
    assert [(r.v, r.ten, r.nine) for r in df.collect()] == [(x, c_form(x), c_form(x, 9)) for x in values]
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,)], "v double").select(sinks.scientific16(F.col("v")).alias("t"))
    assert [r.t for r in odd.collect()] == ["NAN".rjust(16), "INF".rjust(16), "-INF".rjust(16), None]


def test_point_files_hold_the_rounded_doubles(spark, tmp_path):
    """Loads beside the middle of two texts, in files of their own zone read back whole."""
    made = {4: [750985.662515, 3337714.0556], 5: [707910.345275, 282637390005.0]}
    loads = spark.createDataFrame([(1, z, 1997 + i, x) for z, xs in made.items() for i, x in enumerate(xs)], "run_no int, zone_id int, YEAR int, ORGPYR double")
    lines = sinks.point_file_lines(loads).withColumn("file_name", F.format_string("zone%03d.dat", "zone_id"))
    sinks.write_text_files(lines, str(tmp_path / "point"))
    for z, xs in made.items():
        text = spark.read.text(str(tmp_path / "point" / "run_no=1" / f"file_name=zone{z:03d}.dat"), wholetext=True).first()["value"]
        assert text.split("\n")[6:8] == [f" {1997 + i} {c_form(x)}" for i, x in enumerate(xs)]


def test_signed_numbers_of_minus_zero(spark, tmp_path):
    """A balance rounded to -0.0 isn't below zero, so that it keeps ten decimals behind its sign."""
    made = [0.0, -0.0, -0.01, 0.01, -999.99, 9999.99, 65.3244781695, -3015714664.5]
    spark.createDataFrame(list(enumerate(made)), "c_custkey long, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "made"))
    (part,) = (tmp_path / "made").glob("*.parquet")
    part.rename(tmp_path / "customer.parquet")
    got = catalog().queries["k2_signed_numbers"](spark, str(tmp_path))
    assert got.where("c_custkey = 1").first()["plain"] == "-0.0000000000E+00"
    ok, message = compare_with_sql(connect(str(tmp_path)), got, catalog().sql["k2_signed_numbers"])
    assert ok, message


def test_manifest(spark, tmp_path):
    p = spark.createDataFrame([("b", 1.0, 2.0), ("a", 3.0, 0.5)], "raster_id string, x double, y double")
    m = sinks.zonal_manifest(p, "z", "sum", "year", "Sub-basin", "layer")
    sinks.write_manifest(m, str(tmp_path / "m"))
    r = spark.read.json(str(tmp_path / "m")).first()
    assert r["rasters"] == ["a", "b"] and r["bounds"] == [1.0, 0.5, 3.0, 2.0]


def test_compare_frames(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 0.0, 4.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0)], "k int, x double, y double")
    assert {r["name"]: r["n_different"] for r in compare.difference_counts(a, b, ["k"], ["x", "y"]).collect()} == {"x": 1, "y": 1}
    m = {r["name"]: r for r in compare.difference_metrics(a, b, ["k"], ["x"]).collect()}
    assert m["x"]["max_abs_diff"] == 3.0 and m["x"]["mean_rel_diff"] == 0.0
    with pytest.raises(Exception, match="same rows"):
        compare.difference_counts(a, b.where("k = 1"), ["k"], ["x"]).collect()


def test_reconcile(spark):
    w = spark.createDataFrame([("a.chm",), ("b.chm",), ("x.txt",)], "path string")
    r = spark.createDataFrame([("r1", "a.chm"), ("r1", "z.chm"), ("r1", "x.txt"), ("r2", "q.txt")], "name string, path string")
    got = {x["name"]: (x["matched"], x["linked"], x["missing_in_realization"], x["extra_in_realization"]) for x in compare.reconcile_files(w, r, [r"\.chm$"]).collect()}
    assert got == {"r1": (2, 1, 1, 1), "r2": (2, 0, 2, 0)}


def test_equal_frames_are_not_joined(spark):
    """Digests of buckets: only rows of differing buckets meet; counts and means are those of a plain comparison."""
    import random

    rng = random.Random(3)
    rows = [(i, float(rng.randrange(4)), rng.choice((None, 0.0, 2.0, 5.0))) for i in range(2000)]
    a = spark.createDataFrame(rows, "k int, x double, y double")
    other = [(k, x + (k % 97 == 0), y if k % 89 else None) for k, x, y in rows]
    b = spark.createDataFrame(other, "k int, x double, y2 double")
    left, right, _ = compare.differing_rows(a, b, ["k"], [("x", "x"), ("y", "y2")])
    assert {r.k for r in left.collect()} == {r.k for r in right.collect()} and 20 < left.count() < 80
    left, right, same = compare.differing_rows(a, a, ["k"], [("x", "x"), ("y", "y")])
    assert left.count() == right.count() == 0 and {r["name"]: r.cells for r in same.collect()} == {"x": 2000, "y": 2000}
    differs = lambda u, v: u is None or v is None or u != v
    got = {r["name"]: r for r in compare.difference_metrics(a, b, ["k"], ["x"], [("y", "y2")]).collect()}
    for name, pairs in (("x", [(p[1], q[1]) for p, q in zip(rows, other)]), ("y vs y2", [(p[2], q[2]) for p, q in zip(rows, other)])):
        gaps = [abs(u - v) for u, v in pairs if u is not None and v is not None]
        rel = [abs(u - v) / u for u, v in pairs if u and v is not None]
        r = got[name]
        assert r.n_different == sum(differs(u, v) for u, v in pairs) and r.max_abs_diff == max(gaps)
        assert r.mean_abs_diff == pytest.approx(sum(gaps) / len(gaps)) and r.mean_rel_diff == pytest.approx(sum(rel) / len(rel))
    assert {r["name"]: r.n_different for r in compare.difference_counts(a, a, ["k"], ["x", "y"]).collect()} == {"x": 0, "y": sum(y is None for _, _, y in rows)}


def test_runs_are_replaced_and_pruned(spark, tmp_path):
    d = dt.date(2020, 1, 1)
    rows = [(n, "same" if n in (4, 5) else f"r{n}", 1, d + dt.timedelta(i), float(n)) for n in range(1, 7) for i in range(3 if n != 5 else 2)]
    df = spark.createDataFrame(rows + [(3, None, 1, d, 9.0)], "run_no int, run_id string, rch int, date date, v double")
    path = str(tmp_path / "runs")
    tables.write_runs(df, path)
    tables.write_runs(df.where("run_no = 2").withColumn("v", F.lit(-1.0)), path, only_these=True)
    stored = spark.read.parquet(path)
    assert stored.count() == df.count() and {r.v for r in stored.where("run_no = 2").collect()} == {-1.0}
    spark.createDataFrame([(2,), (4,), (5,), (5,), (77,), (None,)], "run_no int").write.parquet(str(tmp_path / "wanted"))
    wanted = spark.read.parquet(str(tmp_path / "wanted")).where("run_no < 50")
    got = {(r.run_no, r.run_id, r.date.day, r.v) for r in tables.read_runs(spark, path, wanted).collect()}
    assert got == {(2, "r2", i, -1.0) for i in (1, 2, 3)} | {(5, "same", 1, 5.0), (5, "same", 2, 5.0), (4, "same", 3, 4.0)}
    plan = tables.read_runs(spark, path, wanted, later_wins=False)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    every = tables.read_runs(spark, path)
    assert every.count() == df.count() - 2 and every.where("run_id is null").count() == 1


def test_only_changed_files_are_read_again(spark, tmp_path):
    import hashlib

    for n in "abcd":
        (tmp_path / f"{n}.txt").write_text(n * 10)
    first = tables.fingerprints(spark, str(tmp_path), kind="t").collect()
    kept = [r for r in first if not r.path.endswith("d.txt")] + [first[0]]
    fake = [r.asDict() | {"sha256": "known"} for r in kept] + [{"path": "gone", "size": 1, "mtime": 0.0, "sha256": "x", "kind": "t"}]
    manifest = spark.createDataFrame(fake, "path string, size long, mtime double, sha256 string, kind string")
    (tmp_path / "b.txt").write_text("changed and longer")
    (tmp_path / "a.txt").unlink()
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in tables.fingerprints_since(spark, str(tmp_path), manifest, "t").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {"b.txt": sha("changed and longer"), "c.txt": "known", "d.txt": sha("d" * 10)}


def test_one_file_for_each_run_and_zone(spark, tmp_path):
    rows = [(r, f"{z:09}.chm", i, None if i == 3 else f"run {r} zone {z} line {i}") for r in (1, 2) for z in range(5) for i in range(1, 40)]
    lines = spark.createDataFrame(rows, "run_no int, file_name string, line_no int, line string").repartition(7)
    sinks.write_text_files(lines, str(tmp_path / "out"))
    for r in (1, 2):
        for z in range(5):
            files = list((tmp_path / "out" / f"run_no={r}" / f"file_name={z:09}.chm").glob("part-*"))
            assert len(files) == 1
            assert files[0].read_text().splitlines() == ["" if i == 3 else f"run {r} zone {z} line {i}" for i in range(1, 40)]
