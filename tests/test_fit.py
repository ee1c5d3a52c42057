"""Properties of fit metrics, bands and shifts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import fit, shift
from freshet.plans import bundles

DAY = dt.date(2020, 1, 1)


def pairs(spark, y, m):
    return spark.createDataFrame([(float(a), None if b is None else float(b)) for a, b in zip(y, m)], "obs double, pred double")


def test_perfect_fit(spark):
    r = fit.pairwise_metrics(pairs(spark, [1, 2, 5], [1, 2, 5])).first()
    assert (r["nse"], r["d"], r["rmse"], r["medae"], r["pbias"]) == (1.0, 1.0, 0.0, 0.0, 0.0)
    assert r["kge"] == pytest.approx(1.0) and r["r"] == pytest.approx(1.0)


def test_against_numpy(spark):
    rng = np.random.default_rng(2)
    y, m = rng.lognormal(size=200), rng.lognormal(size=200)
    r = fit.pairwise_metrics(pairs(spark, y, m)).first()
    assert r["r"] == pytest.approx(np.corrcoef(y, m)[0, 1])
    assert r["nse"] == pytest.approx(1 - ((y - m) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r["nse_rel"] == r["nse"] and r["d_rel"] == r["d"]
    assert r["medae"] == pytest.approx(np.median(np.abs(y - m)))
    assert r["d"] == pytest.approx(1 - ((y - m) ** 2).sum() / ((np.abs(m - y.mean()) + np.abs(y - y.mean())) ** 2).sum())
    e = y - m
    q = fit.residual_moments(pairs(spark, y, m)).first()
    assert q["resid_skew"] == pytest.approx((((e - e.mean()) / e.std()) ** 3).mean())
    slope, icept = np.polyfit(m, y, 1)
    assert (q["slope"], q["intercept"]) == (pytest.approx(slope), pytest.approx(icept))


def test_degenerate_pairs_are_null(spark):
    r = fit.pairwise_metrics(pairs(spark, [2, 2, 2], [1, 2, None])).first()
    assert r["n"] == 2 and r["r"] is None and r["nse"] is None and r["kge"] is None and r["rmse"] is not None
    assert fit.versus_series(pairs(spark, [1], [1]), "x").first()["vs_x_rmse"] is None
    z = fit.core_metrics(pairs(spark, [0, 0], [1, 2])).first()
    assert z["pbias"] is None and z["d_rel"] is None


def test_coverage_grows_with_band(spark):
    rng = np.random.default_rng(4)
    rows = []
    for v in rng.normal(size=300):
        b = np.sort(rng.normal(size=6))
        rows.append((float(v), *map(float, b)))
    df = spark.createDataFrame(rows, "obs double, min double, p05 double, p25 double, p75 double, p95 double, max double")
    r = fit.coverage(df).first()
    assert r["coverage50"] <= r["coverage90"] <= r["coverage100"]
    holes = df.withColumn("min", F.lit(None).cast("double"))
    assert fit.coverage(holes).first()["coverage100"] is None


def test_lag_is_in_days_and_ties_take_the_first(spark):
    q = spark.createDataFrame([(DAY + dt.timedelta(days=2 * i), float(v)) for i, v in enumerate([1, 5, 2, 8, 3, 9])], "date date, p50 double")
    obs = spark.createDataFrame([("s", "a", DAY + dt.timedelta(days=2 * (i + 1)), float(v)) for i, v in enumerate([1, 5, 2, 8, 3])], "station string, analyte string, date date, obs double")
    best = fit.best_lag(fit.lagged_fit(obs, q)).first()
    assert best["best_lag_days"] == 2 and best["r"] == pytest.approx(1.0)
    flat = fit.lagged_fit(obs, q.withColumn("p50", F.lit(1.0)))
    assert fit.best_lag(flat).first()["best_lag_days"] == -2


def test_usage_counts_the_largest_station(spark):
    q = spark.createDataFrame([(DAY + dt.timedelta(days=i), 1.0) for i in range(4)], "date date, p50 double")
    obs = spark.createDataFrame([("a", "x", DAY, 1.0), ("a", "x", DAY + dt.timedelta(days=1), None), ("b", "x", DAY, 2.0)], "station string, analyte string, date date, obs double")
    r = fit.data_usage(q, obs, "2020-01-01", "2020-01-01", any_of=["p50"]).first()
    assert (r["measured_days_total"], r["measured_days_finite"], r["measured_days_windowed"], r["paired_days_used"]) == (2, 1, 1, 2)
    assert r["sim_usage_percent"] == 25.0


def test_shift_signs_and_matrix(spark):
    p = spark.createDataFrame([("s", DAY, 10.0, 8.0), ("s", DAY + dt.timedelta(days=1), 0.0, 1.0), ("s", DAY + dt.timedelta(days=2), 4.0, 4.0)], "scenario string, date date, base double, overlay double")
    r = shift.shift_set(p, agg="both").first()
    assert r["median_delta"] == 0.0 and r["mean_delta"] == pytest.approx(1 / 3) and r["relative_width"] == pytest.approx(0.1)
    m = spark.createDataFrame([("r", "a", "x", 1.0), ("r", "b", "x", 2.0), ("r", "a", "y", 3.0)], "metric string, scenario string, variable string, value double")
    got = {r["scenario"]: r["missing"] for r in shift.metric_matrix(m, m, ["r"], ["x", "y"]).collect()}
    assert got == {"a": "", "b": "y"}


def test_view_statistics_sections(spark):
    rng = np.random.default_rng(8)
    days = [DAY + dt.timedelta(days=i) for i in range(60)]
    q = spark.createDataFrame([(d, *map(float, np.sort(rng.random(7))), float(rng.random())) for d in days], "date date, min double, p05 double, p25 double, p50 double, p75 double, p95 double, max double, mean double")
    obs = spark.createDataFrame([("a", "x", d, float(rng.random())) for d in days[::3]], "station string, analyte string, date date, obs double")
    ex = spark.createDataFrame([("s", d, float(rng.random())) for d in days], "scenario string, date date, value double")
    ev = spark.createDataFrame([(d, i % 5 == 0, i % 5 < 2, True) for i, d in enumerate(days)], "date date, is_event boolean, is_buffered boolean, is_selected boolean")
    rows = {(r["section"], r["name"], r["metric"]): r["value"] for r in bundles.view_statistics(q, obs, extras=ex, events=ev, windows=(1, 2)).collect()}
    assert rows[("same_day", "", "n")] == 20 and rows[("event_context", "", "event_days")] == 12
    assert {"data_usage", "log_space", "global_lag", "local_window_K1", "local_window_K2", "extras", "band_deviation", "measured_vs_series",
            "overlay_comparison", "overlay_full_series", "baseline_summary"} <= {k[0] for k in rows}


def test_lags_by_reach_and_calendar(spark):
    """Two reaches, each fitting its own samples one day later; a gap in the series isn't jumped."""
    import datetime as dt

    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)
    days = [n for n in range(60) if not 20 <= n < 40]
    q = spark.createDataFrame([(r, day(n), float((n * 7 * r) % 23)) for r in (1, 2) for n in days], "rch int, date date, p50 double")
    obs = spark.createDataFrame([(r, day(n + 1), float((n * 7 * r) % 23)) for r in (1, 2) for n in days], "rch int, date date, obs double")
    best = {x.rch: x for x in fit.best_lag(fit.lagged_fit(obs, q, keys=["rch"]), keys=["rch"]).collect()}
    assert {r: (x.best_lag_days, round(x.r, 6)) for r, x in best.items()} == {1: (1, 1.0), 2: (1, 1.0)}
    n = {x.lag: x.n for x in fit.lagged_fit(obs.where("rch = 1").drop("rch"), q.where("rch = 1").drop("rch")).collect()}
    assert n == {-2: 20 + 20 - 6, -1: 20 + 20 - 4, 0: 20 + 20 - 2, 1: 39, 2: 20 + 20 - 3}


def test_view_statistics_by_key_are_those_of_each_series(spark):
    rng = np.random.default_rng(9)
    days = [DAY + dt.timedelta(days=i) for i in range(50)]
    fans = [(r, v, d, *map(float, np.sort(rng.random(7))), float(rng.random())) for r in (1, 2) for v in ("a", "b") for d in days]
    q = spark.createDataFrame(fans, "rch int, variable string, date date, min double, p05 double, p25 double, p50 double, p75 double, p95 double, max double, mean double")
    obs = spark.createDataFrame([(r, v, "s", "x", d, float(rng.random())) for r in (1, 2) for v in ("a", "b") if (r, v) != (2, "b") for d in days[:: 2 + r]],
                                "rch int, variable string, station string, analyte string, date date, obs double")
    ex = spark.createDataFrame([(r, v, n, d, float(rng.random())) for r in (1, 2) for v in ("a", "b") for n in ("s1", "s2") for d in days], "rch int, variable string, scenario string, date date, value double")
    whole = {}
    for r in bundles.view_statistics(q, obs, extras=ex, windows=(2,), keys=["rch", "variable"]).collect():
        whole.setdefault((r.rch, r.variable), {})[r.section, r.name, r.metric] = r.value
    for k, v in ((1, "a"), (2, "a")):
        pick = lambda df: df.where((F.col("rch") == k) & (F.col("variable") == v)).drop("rch", "variable")  # noqa: B023, E731
        one = {(r["section"], r["name"], r["metric"]): r["value"] for r in bundles.view_statistics(pick(q), pick(obs), extras=pick(ex), windows=(2,)).collect()}
        assert whole[k, v].keys() == one.keys()
        assert all((x is None) == (one[m] is None) and (x is None or x == pytest.approx(one[m])) for m, x in whole[k, v].items())
    assert whole[2, "b"]["data_usage", "", "paired_days_used"] == 0 and ("same_day", "", "r") not in whole[2, "b"]
