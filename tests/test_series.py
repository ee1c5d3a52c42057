"""Calendar buckets against pandas, cleaning, events and windows on hand-made frames."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions import bucket, bucket_origin, div, finite
from freshet.operators import duration, ensemble, events, pairing, resample, rolling, select


def daily(spark, start, values, **extra):
    rows = [(start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, v double")


@pytest.mark.parametrize("freq,n,rule", [("D", 1, "1D"), ("D", 5, "5D"), ("W", 1, "1W"), ("W", 2, "2W"), ("W", 3, "3W"), ("M", 1, "1ME"), ("M", 3, "3ME"), ("A", 1, "1YE"), ("A", 2, "2YE")])
@pytest.mark.parametrize("start", [dt.date(2019, 4, 17), dt.date(2020, 2, 29), dt.date(2019, 12, 29)])
def test_buckets_match_pandas(spark, freq, n, rule, start):
    df = daily(spark, start, range(900))
    got = resample.resample(df, [], ["v"], freq, n, "sum")
    got = {r["date"]: r["v"] for r in got.collect()}
    s = pd.Series(np.arange(900.0), index=pd.date_range(start, periods=900))
    want = s.resample(rule).sum(min_count=1).dropna()
    assert got == {k.date(): v for k, v in want.items()}


def test_bucket_needs_origin(spark):
    with pytest.raises(ValueError):
        bucket("date", "M", 3)


def test_unknown_frequency_is_daily_and_bad_count_is_one(spark):
    df = daily(spark, dt.date(2020, 1, 1), [1, 2, 3])
    assert resample.resample(df, [], ["v"], "Q", 0, "sum").count() == 3


def test_sum_of_nothing_is_null_and_weights(spark):
    df = daily(spark, dt.date(2020, 1, 1), [None, None, None]).withColumn("q", F.lit(2.0))
    assert resample.resample(df, [], ["v"], "M", 1, "sum").first()["v"] is None
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 2.0, -1.0), (dt.date(2020, 1, 2), 4.0, 3.0), (dt.date(2020, 1, 3), None, 5.0)], "date date, v double, q double")
    assert resample.resample(df, [], ["v"], "M", 1, "flow_weighted_mean", "q").first()["v"] == pytest.approx(10 / 7)
    assert resample.resample(df, [], ["v"], "M", 1, "flow_weighted_mean", "q", clip_weights=True).first()["v"] == pytest.approx(12 / 8)
    assert resample.resample(df, [], ["v"], "M", 1, "flow_weighted_mean").first()["v"] == 3.0


def test_spine_fills_gaps(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0), (dt.date(2020, 3, 1), 2.0)], "date date, v double")
    out = resample.with_empty_buckets(resample.resample(df, [], ["v"], "M", 1, "sum"), df, [], "M").orderBy("date").collect()
    assert [(r["date"].month, r["v"]) for r in out] == [(1, 1.0), (2, None), (3, 2.0)]


def test_finite_and_div(spark):
    r = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 0.0), (2.0, 0.0)], "a double, b double").select(finite("a").alias("f"), div("a", "b").alias("d")).collect()
    assert [x["f"] for x in r] == [None, None, 2.0] and r[1]["d"] is None and r[2]["d"] is None


def test_measured_policies(spark):
    m = spark.createDataFrame([("LC",), ("-1",), ("2.5",), (None,), ("NaN",)], "value string")
    vals = lambda **k: [r["value_num"] for r in select.clean_measured(m, **k).collect()]
    assert vals() == [None, -1.0, 2.5, None, None]
    assert vals(negative="drop") == [None, 2.5, None, None]
    assert vals(negative="drop", drop_missing_with_negative=True) == [2.5]
    assert vals(nonnum="half_MDL", negative="zero") == [0.1, 0.0, 2.5, 0.1, 0.1]
    assert vals(nonnum="half_MDL", half_mdl=0.05)[0] == 0.05
    assert vals(nonnum="drop") == [-1.0, 2.5]


@pytest.mark.parametrize("token,p", [("q1", .25), ("Q25", .25), ("q2", .5), ("q3", .75), ("p90", .9), ("90pct", .9), ("5", .05), ("100", 1.0)])
def test_threshold_tokens(token, p):
    assert select.threshold_fraction(token) == p


def test_threshold_token_errors():
    for bad in ("q4", "p101", "x", ""):
        with pytest.raises(ValueError):
            select.threshold_fraction(bad)


def test_column_picking(spark):
    df = spark.createDataFrame([(1.0, None, 2.0)], "a double, caudal double, b double")
    assert select.flow_column(df) == "caudal" and select.flow_column(df, "b") == "b"
    assert select.flow_column(df.drop("caudal").withColumn("b", F.lit(None).cast("double"))) == "a"
    assert select.model_flow_column(["x", "flow_out_m3"]) == "flow_out_m3" and select.model_flow_column(["x"]) is None
    assert select.sediment_pair(["SED_INtons", "SED_OUTtons", "SED_IN", "SED_OUT"]) == ("SED_INtons", "SED_OUTtons")
    assert select.sediment_pair(["SED_IN", "x"]) is None
    assert select.value_column(df, ["VALOR"], ["a"]) == "caudal"


def runs_of(mask, need):
    out, i = [False] * len(mask), 0
    while i < len(mask):
        j = i
        while j < len(mask) and mask[j]:
            j += 1
        if j > i and j - i >= need:
            out[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    return out


@pytest.mark.parametrize("cells", [4, 50, 1 << 18])
def test_event_flags_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(events, "TIME_CELLS", cells)
    rng = np.random.default_rng(11)
    gaps = rng.choice([600, 900, 40000], size=400, p=[0.6, 0.35, 0.05])
    t = np.cumsum(gaps)
    q = np.where(rng.random(400) < 0.75, 10.0, 1.0)
    q[100:180] = 10.0  # a run over many cells
    q[50] = np.nan
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=int(s)), None if math.isnan(v) else float(v)) for i, (s, v) in enumerate(zip(t, q))]
    df = spark.createDataFrame(rows, "id long, ts timestamp, q double")
    step = np.median(np.diff(t)) / 86400
    assert events.sampling_interval_days(df).first()[0] == pytest.approx(step)
    days = {"long": 5 * step, "any": step / 2}
    got = {r["id"]: r for r in events.add_event_flags(df, {"long": 5.0, "any": "p50"}, days, tiebreak=["id"]).collect()}
    cut = np.nanpercentile(q, 50)
    for name, th in (("long", 5.0), ("any", cut)):
        want = runs_of([bool(x >= th) for x in q], math.ceil(days[name] / step))
        assert [got[i][f"{name}_event"] for i in range(400)] == want


def test_event_flags_need_interval(spark):
    with pytest.raises(KeyError):
        events.add_event_flags(spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0)], "ts timestamp, q double"), {"a": 1.0}, {})


def test_buffered_and_non_events_cover_all_days(spark):
    df = daily(spark, dt.date(2020, 1, 1), [1, 9, 9, 1, 1, 1, 9, 1]).withColumnRenamed("v", "flow_m3d")
    days = events.event_days(events.daily_events(df, 5.0, 2), 1)
    flags = [(r["is_event"], r["is_buffered"]) for r in days.orderBy("date").collect()]
    assert flags == [(False, True), (True, True), (True, True), (False, True)] + [(False, False)] * 4
    assert events.non_event_days(days, days.where("is_buffered")).count() == 4
    blocks = events.excluded_blocks(days, F.col("is_buffered")).collect()
    assert [(b["start"], b["n_days"]) for b in blocks] == [(dt.date(2020, 1, 5), 4)]


def test_outliers_without_spread_flag_nothing(spark):
    df = daily(spark, dt.date(2020, 1, 1), [5, 5, 5, 100]).withColumnRenamed("v", "flow_m3d")
    assert events.outlier_days(df).where("is_outlier").count() == 0
    assert events.outlier_days(df, "quantile", upper_q=0.9).where("is_outlier").count() == 1
    with pytest.raises(ValueError):
        events.outlier_days(df, "other")


def test_rolling_matches_pandas(spark):
    vals = [1, None, 3, 8, None, None, 2, 5, 4]
    for how, f in (("mean", "mean"), ("median", "median")):
        got = [r["v"] for r in rolling.rolling(daily(spark, dt.date(2020, 1, 1), vals), [], "date", ["v"], 4, how).orderBy("date").collect()]
        want = getattr(pd.Series(vals, dtype=float).rolling(4, min_periods=2), f)()
        assert [None if v is None else round(v, 9) for v in got] == [None if math.isnan(v) else round(v, 9) for v in want]


def test_fan_is_monotone(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(str(i % 7), 1, dt.date(2020, 1, 1) + dt.timedelta(days=i // 7), float(v)) for i, v in enumerate(rng.normal(size=140))], "run_id string, rch int, date date, v double")
    for r in ensemble.fan(df, ["rch"], "v").collect():
        line = [r[c] for c in ("min", "p05", "p10", "p25", "p50", "p60", "p75", "p90", "p95", "max")]
        assert line == sorted(line) and r["n_values"] == 7


def test_nearest_day_ties_go_later_and_nearest_value_ties_go_first(spark):
    q = spark.createDataFrame([(dt.date(2020, 1, 1), 5.0), (dt.date(2020, 1, 3), 5.0)], "date date, p50 double")
    s = spark.createDataFrame([("a", "x", dt.date(2020, 1, 2), 4.0)], "station string, analyte string, date date, obs double")
    assert pairing.match_nearest_day(s, q, ["p50"]).first()["model_date"] == dt.date(2020, 1, 3)
    assert pairing.match_local_window(s, q, 1).first()["k_days"] == -1
    assert pairing.match_local_window(s, q, 0).count() == 0
    assert pairing.match_local_window(s, q, 1, "mean").first()["pred"] == 5.0


def test_proxy_lookup(spark):
    m = spark.createDataFrame([("TOT_N", 1, 100, "A"), ("TOT_N", 1, 90, "B"), ("TOT_N", 1, 90, "C"), ("TOT_N", 1, 70, "D"), ("TOT_N", 1, 5, "E"), ("Other", 2, 1, "X"), ("Other", 2, 3, "Y"),
                               ("o", 3, 50, "late")], "entry string, pos int, weight int, analyte string")
    names = spark.createDataFrame([(v,) for v in ("TOT_N", " tot_n ", "other_kg", "zzz", "OT", "", None)], "variable string")
    got = {}
    for r in pairing.resolve_proxies(m, names).collect():
        got.setdefault(r.variable, []).append((r.category, r.analyte))
    heavy = [(1, "A"), (2, "B"), (2, "C"), (3, "D")]
    assert {v: sorted(x) for v, x in got.items()} == {"TOT_N": heavy, " tot_n ": heavy, "other_kg": [(1, "X"), (3, "Y")], "OT": heavy}


def test_samples_meet_their_own_reach_and_variable(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    q = spark.createDataFrame([(r, v, day(i), float(100 * r + 10 * len(v) + i), 1.0, 2.0) for r in (1, 2) for v in ("a", "bb") for i in range(6)], "rch int, variable string, date date, p50 double, p90 double, mean double")
    daily = spark.createDataFrame([(f"s{r}", a, day(3), 100.0 * r) for r in (1, 2, 3) for a in ("x", "y")], "station string, analyte string, date date, obs double")
    sites = spark.createDataFrame([("s1", "x", 1, "a"), ("s1", "y", 1, "bb"), ("s2", "x", 2, "a"), ("s2", "x", 2, "bb")], "station string, analyte string, rch int, variable string")
    at, keys = pairing.at_sites(daily, sites), ["rch", "variable"]
    want = {(1, "a", "x"): 113.0, (1, "bb", "y"): 123.0, (2, "a", "x"): 213.0, (2, "bb", "x"): 223.0}
    assert {(r.rch, r.variable, r.analyte): r.pred for r in pairing.pair_same_day(at, q, by=keys).collect()} == want
    assert {(r.rch, r.variable, r.analyte): (r.pred, r.k_days) for r in pairing.match_local_window(at, q, 2, by=keys).collect()} == {k: (v - 2, -2) for k, v in want.items()}
    assert {(r.rch, r.variable, r.analyte): r.p50 for r in pairing.match_nearest_day(at, q.where(F.col("date") != day(3)), ["p50"], by=keys).collect()} == {k: v + 1 for k, v in want.items()}
    holes = q.withColumn("p90", F.when(F.col("rch") == 1, F.col("p90")))
    events = spark.createDataFrame([(day(3), 2)], "date date, rch int")
    flags = {(r.rch, r.variable): (r.ratio, r.label) for r in pairing.flag_deviation(at, holes, events, by=keys).collect()}
    assert flags[1, "a"] == (100.0, "deviation") and flags[2, "bb"] == (200.0 / 223.0, "flow-outlier")


def test_stratified_curve_needs_five_days(spark):
    d = [dt.date(2020, 1, i) for i in range(1, 5)]
    loads = spark.createDataFrame([(x, 3.0, 1.0, 2.0) for x in d], "date date, l_min double, l_mean double, l_max double")
    flow = spark.createDataFrame([(x, 1.0) for x in d], "date date, flow_m3d double")
    assert duration.flow_stratified(loads, flow).count() == 0
    more = [dt.date(2020, 2, i) for i in range(1, 7)]
    loads = spark.createDataFrame([(x, 3.0, 1.0, 2.0) for x in more], loads.schema)
    flow = spark.createDataFrame([(x, float(i)) for i, x in enumerate(more)], flow.schema)
    out = duration.flow_stratified(loads, flow, bin_step=0)
    assert {(r["y_min"], r["y_mean"], r["y_max"]) for r in out.collect()} == {(1.0, 2.0, 3.0)}


def test_same_result_at_any_shuffle_width(spark):
    df = spark.range(2000).select((F.col("id") % 5).cast("string").alias("run_id"), F.lit(1).alias("rch"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 5).cast("int")).alias("date"), (F.col("id") * 7 % 113).cast("double").alias("v"))
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, resample.resample(ensemble.fan(df, ["rch"], "v", [50]), ["rch"], ["p50"], "M").collect()))
    assert run("1") == run("8")


def test_origin_is_shared_by_runs(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("b", dt.date(2020, 1, 3), 1.0)], "run_id string, date date, v double")
    labels = {r["run_id"]: r["date"] for r in resample.resample(df, ["run_id"], ["v"], "D", 5, "sum", origin=bucket_origin(df)).collect()}
    assert labels == {"a": dt.date(2020, 1, 1), "b": dt.date(2020, 1, 1)}


def test_events_of_several_gauges(spark, monkeypatch):
    """Each gauge has its own threshold, interval and runs; one gauge holds half of all rows; runs cross cells."""
    import random

    from freshet.operators import events

    rng = random.Random(5)
    rows, at = [], dt.datetime(2020, 1, 1)
    for i in range(3000):
        at += dt.timedelta(minutes=rng.choice((1, 5, 5, 5, 60, 600)))
        rows.append((i, None if i % 97 == 0 else rng.choice(("hot", "hot", "hot", "b", "c")), at, rng.choice((0.0, 1.0, 5.0, 9.0, 9.0, 9.0)) if i % 41 else None))
    rows.append((3000, "single", at, 9.0))
    monkeypatch.setattr(events, "TIME_CELLS", 300)
    df = spark.createDataFrame(rows, "id int, g string, ts timestamp, q double").repartition(7)
    got = {r.id: (r.hi_event, r.fix_event) for r in events.add_event_flags(df, {"hi": "p50", "fix": 5.0}, {"hi": 0.008, "fix": 0.02}, keys=["g"]).collect()}
    assert len(got) == len(rows)
    want = {i: (False, False) for i, g, _, _ in rows if g in (None, "single")}
    for g in ("hot", "b", "c"):
        own = sorted((t, i, q) for i, k, t, q in rows if k == g)
        gaps = sorted((y[0] - x[0]).total_seconds() / 86400 for x, y in zip(own, own[1:]))
        step = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2
        qs = sorted(q for _, _, q in own if q is not None)
        flags = []
        for cut, days in (((qs[(len(qs) - 1) // 2] + qs[len(qs) // 2]) / 2, 0.008), (5.0, 0.02)):
            run, out = [], {}
            for _, i, q in [*own, (None, None, None)]:
                if i is not None and q is not None and q >= cut:
                    run.append(i)
                    continue
                out |= {k: len(run) >= -(-days // step) for k in run} | {i: False}
                run = []
            flags.append(out)
        want |= {i: (flags[0][i], flags[1][i]) for _, i, _ in own}
    assert got == want and 100 < sum(a for a, _ in got.values()) < 2500
    steps = {r.g: r.dt_days for r in events.sampling_interval_days(df, keys=["g"]).collect()}
    assert steps.keys() == {"hot", "b", "c"}
    assert events.add_event_flags(df.limit(0), {"hi": "p50"}, {"hi": 1.0}, keys=["g"]).count() == 0
