"""Zones, yearly population and scenarios on hand-made frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import balance, duration, scenario, zones
from freshet.sources import tables

RING = "array<struct<x:double,y:double>>"


def polygons(spark):
    sq = lambda x, y: [(x, y), (x + 10.0, y), (x + 10.0, y + 10.0), (x, y + 10.0)]
    rows = [("1", sq(0.0, 0.0)), ("2", sq(10.0, 0.0)), ("3", sq(50.0, 50.0)), (None, sq(0.0, 0.0)), ("", sq(0.0, 0.0)), ("NA", sq(0.0, 0.0)),
            ("9", [(0.0, 20.0), (20.0, 20.0), (10.0, 25.0), (20.0, 30.0), (0.0, 30.0)])]  # concave
    return spark.createDataFrame(rows, f"zone_id string, ring {RING}").withColumn("area_m2", F.lit(100.0))


@pytest.mark.parametrize("cell", [3.0, 10.0, 1000.0])
def test_pixels_in_zones(spark, cell):
    pts = [("r_1970", 5.0, 5.0, 2.0), ("r_1970", 10.0, 5.0, 3.0), ("r_1970", 12.0, 0.0, 5.0), ("r_1970", 15.0, 25.0, 7.0), ("r_1970", 5.0, 25.0, 11.0), ("r_1970", 30.0, 30.0, 1.0), ("r_1980", 5.0, 5.0, 0.0)]
    px = spark.createDataFrame(pts, "raster_id string, x double, y double, value double")
    got = sorted((r["x"], r["y"], r["zone_id"]) for r in zones.pixels_in_zones(px.where("raster_id = 'r_1970'"), polygons(spark), cell).collect())
    assert got == [(5.0, 5.0, "1"), (5.0, 25.0, "9"), (10.0, 5.0, "2"), (12.0, 0.0, "2")]  # a shared edge counts once
    wide = {r["zone_id"]: r.asDict() for r in zones.zonal_wide(px, polygons(spark), cell, ["r_1970", "r_1980"]).collect()}
    assert set(wide) == {"1", "2", "3", "9"}
    assert (wide["2"]["sum_1970"], wide["2"]["pixels_included_1970"]) == (8.0, 2)
    assert (wide["3"]["sum_1970"], wide["3"]["pixels_included_1980"], wide["1"]["sum_1980"]) == (0.0, 0, 0.0)


def test_random_pixels_against_brute_force(spark):
    rng = np.random.default_rng(9)
    ang = np.sort(rng.random(12)) * 2 * np.pi
    poly = [(float(50 + (20 + 20 * rng.random()) * np.cos(a)), float(50 + (20 + 20 * rng.random()) * np.sin(a))) for a in ang]
    pts = rng.random((800, 2)) * 100
    z = spark.createDataFrame([(1, poly)], f"zone_id int, ring {RING}")
    px = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = {r["id"] for r in zones.pixels_in_zones(px, z, 7.0).collect()}

    def inside(x, y):
        hit = False
        for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    assert got == {i for i, (x, y) in enumerate(pts) if inside(x, y)}


def test_rings_holes_and_unequal_zones(spark):
    """Zones with holes, islands and parts, sizes 1000 times apart, against the plain even-odd rule."""
    rng = np.random.default_rng(3)

    def blob(cx, cy, r, n):
        a = np.sort(rng.random(n)) * 2 * np.pi
        k = r * (0.6 + 0.4 * rng.random(n))
        return [(float(cx + d * np.cos(t)), float(cy + d * np.sin(t))) for d, t in zip(k, a)]

    shapes = [(0, [blob(0, 0, 1000, 400), blob(50, 50, 300, 100), blob(60, 60, 80, 30), blob(1500, -200, 150, 40)])]
    shapes += [(i, [blob(float(rng.uniform(-800, 800)), float(rng.uniform(-800, 800)), 1.5, 9)]) for i in range(1, 40)] + [(90, []), (91, None), (92, [[(0.0, 0.0)]])]
    z = spark.createDataFrame(shapes, f"zone_id int, rings array<{RING}>")
    pts = np.concatenate([rng.uniform(-1100, 1700, (3000, 2)), *[np.array(r[0][0]) + rng.uniform(-3, 1, (20, 2)) for _, r in shapes[1:40]]])
    px = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(-1, None, 0.0)], "id int, x double, y double").withColumn("level", F.lit("own"))
    got = {(r["id"], r["zone_id"]) for r in zones.pixels_in_zones(px, z, 0.5).collect()}
    want = set()
    for zone, rings in shapes:
        edges = [(p, q) for r in rings or [] for p, q in zip(r, r[1:] + r[:1])]
        for i, (x, y) in enumerate(pts):
            if sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in edges) % 2:
                want.add((i, zone))
    assert got == want and len({k for _, k in want}) > 30
    cover, top = zones.zone_cover(z, 0.5)
    cells = cover.groupBy("zone_id").agg(F.count("*").alias("n"), F.max(F.size("edges")).alias("edges"), F.sum((F.size("edges") == 0).cast("int")).alias("inner")).collect()
    large = next(c for c in cells if c.zone_id == 0)
    assert large.n < 8 * 570 and large.inner > 50  # a grid of that cell would have millions
    assert all(c.edges <= zones.MOST_EDGES for c in cells if c.zone_id) and top <= 14


def test_uncertainty(spark):
    px = spark.createDataFrame([("r", 5.0, 5.0, 10.0, 1.0, 9.0), ("r", 6.0, 6.0, 0.0, 2.0, 9.0), ("r", 12.0, 5.0, 4.0, None, 1.0)], "raster_id string, x double, y double, value double, se double, q50 double")
    r = zones.grid_uncertainty(px, "rmse_rel_center").first()
    assert r["half_width_rel"] == pytest.approx(np.sqrt(2.5) / 5)
    assert zones.grid_uncertainty(px).first()["half_width_rel"] == 2.0  # a zero centre clips
    assert zones.grid_uncertainty(px, "fixed_rel", fixed_rel=1.5).first()["lower_factor"] == 0.0
    with pytest.raises(ValueError):
        zones.grid_uncertainty(px, "fixed_rel")
    per = zones.zone_uncertainty(px, polygons(spark), 10.0, 4.0)
    row = per.first()
    n_eff = max(1.0, min(2, 100 / (np.pi * 16)))
    assert per.count() == 1 and row["half_width_rel"] == pytest.approx(1.96 * np.sqrt(2.5 / n_eff) / 5)
    assert zones.collapse_zone_uncertainty(per, "max").first()["half_width_rel"] == row["half_width_rel"]


def test_year_columns():
    cols = ["GRIDCODE", "popul_sum_1970", "pixels_included_1970", "sum_1981", "other_1981", "1991", "name"]
    assert zones.year_columns(cols) == {"popul_sum_1970": 1970, "sum_1981": 1981, "1991": 1991}


def test_interpolation(spark):
    wide = zones.normalise_years(spark.createDataFrame([("3,0", "100", "bad", "200")], "zone_id string, sum_1970 string, sum_1975 string, sum_1980 string"))
    got = {r["year"]: r["population"] for r in zones.interpolate_years(wide, 1968, 1982).collect()}
    assert got[1968] == 100.0 and got[1970] == 100.0 and got[1975] == 150.0 and got[1980] == 200.0 and got[1982] == 200.0
    legacy = {r["year"]: r["population"] for r in zones.interpolate_years(wide, 1972, 1983, legacy=True).collect()}
    assert legacy[1972] == 200 and len(legacy) == 12  # 1970 lies outside the range
    ex = {r["year"]: r["population"] for r in zones.extrapolate_years(wide.drop("1975")).collect()}
    assert ex[1981] == 210 and ex[2025] == 650
    with pytest.raises(ValueError, match="No integer year columns"):
        zones.interpolate_years(spark.createDataFrame([(1, 2.0)], "zone_id int, Area double"), 1970, 1980)


def test_point_loads(spark):
    long = spark.createDataFrame([(1, 2000, 1000.0)], "zone_id int, year int, population double")
    r = zones.point_loads(long, {"NO3YR": {"mean": 20, "standard": 1}, "CHLAYR": None}, None, fill_missing=True).first()
    assert r["FLOYR"] == 150.0 and r["NO3YR"] == 3.0 and r["CHLAYR"] == 0.0 and r["CMTL3YR"] == 0.0
    assert zones.point_loads(long, {}, None).columns == ["zone_id", "YEAR", "FLOYR"]
    assert [zones.resolve_litres(x) for x in (None, 80, {"standard": 90}, {"value": 70, "standard": 90}, {"lower": 1})] == [150.0, 80.0, 90.0, 70.0, 150.0]


def test_loads_round_as_doubles(spark):
    """1257.75 people at 4.5 mg/L and 180 L make 1.0187775, whose double lies below the middle of two."""
    long = spark.createDataFrame([(1, 2002, 1257.75), (2, 2002, 1286.55)], "zone_id int, year int, population double")
    got = zones.point_loads(long, {"ORGPYR": 4.5}, 180.0).orderBy("zone_id").collect()
    assert [r.ORGPYR for r in got] == [round(4.5 * 180 * p / 1e6, 6) for p in (1257.75, 1286.55)] == [1.018777, 1.042105]


SPEC = {"transforms": [
    {"type": "ops", "ops": [{"op": "mul", "src": "a", "out": "b", "standard": 2.0, "lower": 1.0, "upper": 3.0}, {"op": "add", "src": "b", "out": "c", "lower": 5.0, "upper": 5.0, "standard": 5.0}]},
    {"type": "split", "src": "c", "outputs": [{"name": "x", "standard": 0.5, "lower": 0.2, "upper": 0.8}, {"name": "y", "standard": 0.3}]},
    {"type": "build_point", "mgL_values": {"NO3YR": {"mean": 20.0, "lower": 10.0, "upper": 30.0}}}]}


def test_scenario_modes(spark):
    p = scenario.params_from_spec(spark, SPEC)
    assert p.count() == 6 and scenario.bounded(p).count() == 3
    ext = scenario.overrides(p, "extreme")
    assert ext.select("run_no").distinct().count() == 8
    by_run = {}
    for r in ext.where("source is not null").collect():
        by_run.setdefault(r["run_no"], []).append((r["pos"], r["value"]))
    combos = [tuple(v for _, v in sorted(by_run[i])) for i in range(1, 9)]
    assert combos == [(a, b, c) for a in (1.0, 3.0) for b in (0.2, 0.8) for c in (10.0, 30.0)]
    assert {r["value"] for r in scenario.overrides(p, "mean").where("name = 'NO3YR'").collect()} == {20.0}
    assert [r["value"] for r in scenario.overrides(p, "minmax").where("name = 'b'").orderBy("run_no").collect()] == [1.0, 3.0]
    with pytest.raises(ValueError):
        scenario.overrides(p, "other")


def test_random_draws(spark):
    p = scenario.params_from_spec(spark, SPEC)
    a = scenario.overrides(p, "random", 500, 3)
    s = a.where("name = 'b'").agg(F.min("value"), F.max("value"), F.avg("value"), F.count_distinct("value")).first()
    assert 1.0 <= s[0] and s[1] < 3.0 and abs(s[2] - 2.0) < 0.1 and s[3] == 500
    key = lambda df: sorted((r["run_no"], r["pos"], r["value"]) for r in df.collect())
    assert key(a) == key(scenario.overrides(p.repartition(5), "random", 500, 3))
    assert key(a) != key(scenario.overrides(p, "random", 500, 4))


def test_run_from_spec(spark):
    base = spark.createDataFrame([(1, 10.0), (2, 0.0)], "zone_id int, a double")
    rows = scenario.run_from_spec(base, SPEC, "mean").orderBy("zone_id").collect()
    assert (rows[0]["b"], rows[0]["c"]) == (20.0, 25.0) and rows[0]["x"] + rows[0]["y"] == pytest.approx(25.0)
    assert scenario.run_from_spec(base, SPEC, "extreme").count() == 16


def test_rows_multiplied_by_run_are_never_sent(spark, monkeypatch):
    """Spark's estimate of the rows leaves out the runs and that of the runs can be anything, so it must not choose the side."""
    base = spark.range(50).select(F.col("id").alias("zone_id"), F.lit(2.0).alias("v0"))
    runs = spark.createDataFrame([(1, 0.5), (2, 1.5), (4, 2.5)], "run_no long, v1 double")
    shares = spark.createDataFrame([(r, n, f) for r in (1, 2, 4) for n, f in (("a", 0.25), ("b", 0.75))], "run_no long, name string, fraction double")
    want = sorted((z, 2.0, r, v) for z in range(50) for r, v in ((1, 0.5), (2, 1.5), (4, 2.5)))
    for most, join in ((scenario.SENT_RUNS, "BroadcastHashJoin"), (2, "ShuffledHashJoin")):
        monkeypatch.setattr(scenario, "SENT_RUNS", most)
        met = scenario.base_by_run(base, runs)
        split = scenario.split_column(met.drop("v1"), "v0", shares, ["a", "b"])
        for df in (met, split):
            joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x]
            assert joins and all(join in x and "BuildRight" in x for x in joins)
        assert sorted(met.select("zone_id", "v0", "run_no", "v1").collect()) == want
        assert {(r.run_no, r.a, r.b) for r in split.collect()} == {(1, 0.5, 1.5), (2, 0.5, 1.5), (4, 0.5, 1.5)}


def test_operations(spark):
    df = spark.createDataFrame([(4.0,)], "a double")
    r = scenario.apply_ops(df, [{"op": "mul", "src": "a", "out": "b"}, {"op": "set", "out": "c", "standard": 7}, {"op": "set", "src": "a", "out": "d"},
                                {"mode": "absolute", "src": "a", "mean": 1.5}, {"op": "set", "out": "e"}]).first()
    assert r.asDict() == {"a": 5.5, "c": 7.0, "d": 4.0}
    with pytest.raises(ValueError):
        scenario.apply_ops(df, [{"op": "pow", "src": "a"}])
    f = scenario.split_fractions(spark.createDataFrame([(1, 1, "x", 2.0), (1, 1, "y", -2.0), (2, 1, "x", 1.0), (2, 1, "y", 3.0)], "run_no int, step_no int, name string, ratio double"))
    assert {(r["run_no"], r["name"]): r["fraction"] for r in f.collect()} == {(1, "x"): 2.0, (1, "y"): -2.0, (2, "x"): 0.25, (2, "y"): 0.75}
    d = scenario.perturbations(spark.createDataFrame([(1,)], "run_no int"), [{"name": "a", "bound": 0.2}, {"name": "b", "delta": 0.5, "bound": 0.1}, {"name": "c"}]).collect()
    assert [r["source"] for r in d] == ["random", "override", "none"] and abs(d[0]["delta"]) <= 0.2
    assert {tuple(sorted(r.asDict().items())) for r in scenario.per_run(scenario.corner_runs(spark, {"n": 0.5, "p": 0.1}), ["n", "p"]).collect()} == {
        (("n", n), ("p", p), ("run_no", i)) for i, (n, p) in enumerate([(0.5, 0.9), (0.5, 1.1), (1.5, 0.9), (1.5, 1.1)], 1)}


def test_balance_signs(spark):
    import datetime as dt
    d = dt.date(2020, 2, 29)
    r = spark.createDataFrame([("r", 1, d, 10.0, 30.0, 0.0)], "run_id string, rch int, date date, sed_in double, sed_out double, flow_cms double")
    s = spark.createDataFrame([(1, d, 2.0, 0.0, 0.05)], "sub int, date date, area_km2 double, wyld double, syld double")
    m = {k: balance.channel_balance(r, s, "SED", k).first()["metric"] for k in ("A", "B", "C1", "C2")}
    assert m["A"] == pytest.approx(10.0) and m["B"] == -m["A"] and m["C1"] is None and m["C2"] is None
    assert balance.channel_balance(r, s, drop_leap_day=True).count() == 0
    with pytest.raises(ValueError):
        balance.channel_balance(r, s, "SED", "Z")
    with pytest.raises(ValueError):
        balance.channel_balance(r, s, "XX")


def test_population_table_without_years(spark, tmp_path):
    (tmp_path / "p.csv").write_text("OBJECTID;GRIDCODE;Area;Bname\n1;7;12.5;\n2;9;3.25;\n")
    df = tables.read_population(spark, str(tmp_path / "p.csv"))
    assert [r["GRIDCODE"] for r in df.orderBy("GRIDCODE").collect()] == [7, 9]
    with pytest.raises(ValueError, match="No integer year columns"):
        zones.interpolate_years(zones.normalise_years(df, "GRIDCODE"), 1970, 1980, "GRIDCODE")


def test_flow_source_choice():
    assert duration.choose_flow("gauge", "model") == "model" and duration.choose_flow("gauge", "model", "external") == "gauge"
    assert duration.choose_flow("gauge", None, "model") == "gauge" and duration.choose_flow(None, None) is None
