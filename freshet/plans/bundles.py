"""Composed reports: all statistics of a view, and a fit evaluation from raw frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators import ensemble, fit, pairing, resample, select, shift


def _long(df: DataFrame, section: str, name: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Every number of a frame as (keys, section, name, metric, value)."""
    skip = {*keys, name}
    numeric = [f.name for f in df.schema if f.name not in skip and f.dataType.typeName() in ("double", "long", "integer", "float")]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])
    label = F.col(name).cast("string") if name else F.lit("")
    return df.select(*keys, F.lit(section).alias("section"), label.alias("name"), F.explode(cells).alias("c")).select(*keys, "section", "name", "c.*")


SUMMARY = ("n", "mean", "sd", "var", "min", "max", "p05", "p25", "median", "p75", "p95")


def _spread(pairs: DataFrame, obs: DataFrame, q: DataFrame, windows: dict[int, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Distributions, median error and lag spread of all series: one set of quantiles for all of them, each under a name of its own."""
    cell = lambda n, c: F.struct(F.lit(n).alias("of"), c.cast("double").alias("v"))
    flat = lambda df, *cells: df.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*")
    o, p = F.col("obs"), F.col("pred")
    values = reduce(DataFrame.unionByName, [
        flat(pairs, cell("paired_observed", o), cell("paired_predicted", p), cell("error", F.abs(o - p))),
        flat(obs, cell("observed", o)), flat(q, cell("predicted", F.col("p50"))),
        *[flat(m, cell(f"K{k}", F.col("k_days")), cell(f"zero{k}", F.when(F.col("k_days") == 0, 1.0).otherwise(0.0))) for k, m in windows.items()]])
    s = fit.distribution_summary(values, "v", [*keys, "of"])
    cells = lambda pick: F.array(*[F.struct(F.lit(sec).alias("section"), F.lit(m).alias("metric"), c.cast("double").alias("value")) for sec, m, c in pick])
    rows = F.when(F.col("of") == "error", cells([("same_day", "medae", F.col("median"))]))
    for name in ("paired_observed", "paired_predicted", "observed", "predicted"):
        rows = rows.when(F.col("of") == name, cells([(f"distribution_{name}", m, F.col(m)) for m in SUMMARY]))
    for k in windows:
        rows = rows.when(F.col("of") == f"K{k}", cells([(f"local_window_K{k}", "median_lag_days", F.col("median")), (f"local_window_K{k}", "iqr_lag_days", F.col("p75") - F.col("p25"))]))
        rows = rows.when(F.col("of") == f"zero{k}", cells([(f"local_window_K{k}", "fraction_zero_lag", F.col("mean"))]))
    return s.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.section", F.lit("").alias("name"), "c.metric", "c.value")


def _fits(pairs: DataFrame, windows: dict[int, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Moment-based metrics of the pairs, of their logarithms and of the local windows, from one aggregate."""
    o, p = F.col("obs"), F.col("pred")
    cell = lambda n, a, b: F.struct(F.lit(n).alias("of"), a.alias("obs"), b.alias("pred"))
    both = (o > 0) & (p > 0)
    flat = lambda df, *cells: df.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*")
    rows = reduce(DataFrame.unionByName, [
        flat(pairs, cell("same_day", o, p), cell("log_space", F.when(both, F.log10(o)), F.when(both, F.log10(p)))),
        *[flat(m, cell(f"local_window_K{k}", o, p)) for k, m in windows.items()]])
    c = fit.core_metrics(rows, [*keys, "of"])
    full = [("n", "n"), *[(m, m) for m in fit.METRICS if m != "medae"]]
    log = [("n_pos", "n"), ("r_log", "r"), ("r2_log", "r2"), ("rmse_log10", "rmse"), ("mae_log10", "mae"), ("nse_log", "nse"), ("d_log", "d")]
    cells = lambda pick: F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in pick])
    picked = F.when(F.col("of") == "same_day", cells(full)).when(F.col("of") == "log_space", cells(log)).otherwise(cells([(m, m) for m in ("n", "rmse", "mae", "bias", "nse")]))
    return c.select(*keys, F.col("of").alias("section"), F.lit("").alias("name"), F.explode(picked).alias("c")).select(*keys, "section", "name", "c.*")


def view_statistics(
    q: DataFrame, daily: DataFrame, start: str | None = None, end: str | None = None, extras: DataFrame | None = None,
    events: DataFrame | None = None, max_lag: int = 2, windows: Sequence[int] = (1,), strategy: str = "nearest",
    choose_by: str = "r", shift_agg: str = "median", keys: Sequence[str] = (),
) -> DataFrame:
    """All statistics of a view as (keys, section, name, metric, value).

    ``q`` is the fan with mean, min, max and percentiles per date; ``daily`` has the samples per station, analyte and day;
    ``extras`` the named series (scenario, date, value); ``events`` the day table of flow events. ``keys``, such as rch and
    variable, tell series apart in q, daily and extras, and each of them gets its own statistics; without them there is one series.
    The counts of event days belong to no series. Nothing runs before the result is asked for; metrics of all kinds of
    pairs share one aggregate, and all distributions one set of quantiles.
    """
    keys = list(keys)
    long = lambda df, section, name=None: _long(df, section, name, keys)
    usage = long(fit.data_usage(q, daily, start, end, keys=keys), "data_usage")
    view = lambda df: select.time_slice(df, start, end)
    obs = view(daily)
    pairs = pairing.pair_same_day(obs, q, by=keys)
    qv = view(q)
    lw = {k: pairing.match_local_window(obs, q, k, strategy, by=keys) for k in windows}
    near = pairing.match_nearest_day(obs, qv, ["min", "p05", "p25", "p50", "p75", "p95", "max", "mean"], by=keys)
    own = qv.select(*keys, "date", "p50", F.lit("baseline").alias("scenario"))
    parts = [
        usage,
        _fits(pairs, lw, keys),
        _spread(pairs, obs, qv, lw, keys),
        long(fit.coverage(pairs, keys), "same_day"),
        long(fit.best_lag(fit.lagged_fit(obs, q, max_lag, keys=keys), choose_by, keys), "global_lag"),
        long(fit.band_deviation(qv, keys), "band_deviation"),
        long(fit.percentile_band_deviation(qv, keys), "band_deviation"),
        long(fit.band_coverage(near, keys), "measured_vs_series"),
        long(shift.baseline_summary(qv, keys=keys), "baseline_summary"),
        long(shift.envelope_widths(own, qv, "p50", [*keys, "scenario"]), "baseline_envelope", "scenario"),
    ]
    if extras is not None:
        ex = view(extras)
        by = [*keys, "scenario"]
        sp = pairing.pair_scenarios(ex, qv, by=keys)
        parts += [
            long(fit.correlation_with(obs, ex, name="scenario", keys=keys), "extras", "scenario"),
            long(shift.shift_set(sp, by, shift_agg), "overlay_comparison", "scenario"),
            long(shift.stratified_widths(sp, qv, keys=by), "overlay_comparison", "scenario"),
            long(shift.envelope_widths(sp, qv, keys=by), "overlay_comparison", "scenario"),
            long(shift.overlay_metrics(sp, by), "overlay_full_series", "scenario"),
        ]
        if events is not None:
            parts.append(long(shift.event_shift(sp, events, by), "overlay_comparison", "scenario"))
    if events is not None:
        n = lambda c: F.count(F.when(c, 1))
        days = _long(events.agg(
            n(F.col("is_event")).alias("event_days"), n(F.col("is_buffered")).alias("buffered_days"),
            n(~F.col("is_buffered")).alias("non_event_days"), n(F.col("is_selected")).alias("selected_days"),
            F.count(F.lit(1)).alias("all_days")), "event_context")
        parts.append(days.withColumns({k: F.lit(None).cast(q.schema[k].dataType) for k in keys}))
    return reduce(DataFrame.unionByName, parts)


def evaluate_fit(
    sim: DataFrame, measured: DataFrame, variable: str | Sequence[str], rch: int | None = None, freq: str = "D", n: int = 1, method: str = "sum",
    start: str | None = None, end: str | None = None, months: Sequence[int] | None = None,
    analytes: Sequence[str] | None = None, stations: Sequence[str] | None = None, nonnum: str = "as_na",
    negative: str = "zero", flow: str = "flow_cms", sites: DataFrame | None = None, **options,
) -> DataFrame:
    """Fit of an ensemble to lab samples, from the raw frames.

    Filters the window and the season; resamples each run; builds the fan across runs; cleans, averages and resamples the
    samples; and reports the view statistics. With ``sites`` (station, analyte, rch, variable) every reach and variable is
    compared with the samples that stand for it; else all samples are those of one reach and variable.
    """
    variables = [variable] if isinstance(variable, str) else list(variable)
    columns = list(dict.fromkeys(["run_id", "rch", "date", *variables, flow]))
    runs = select.reach(sim, rch, columns) if rch is not None else sim.select(*columns)
    runs = select.season(select.time_slice(runs, start, end), months)
    clean = select.clean_measured(measured, nonnum=nonnum, negative=negative)
    daily = pairing.measured_daily(clean, "value_num", analytes, stations, start, end, months)
    if freq != "D" or n > 1:
        daily = resample.resample(daily, ["station", "analyte"], ["obs"], freq, n, "mean")
    if sites is None:
        if len(variables) > 1 or rch is None:
            raise ValueError("several reaches or variables need sites")
        series = resample.resample(runs, ["run_id"], variables, freq, n, method, flow=flow)
        return view_statistics(ensemble.fan(series, [], variables[0]), daily, **options)
    series = resample.resample(runs, ["run_id", "rch"], variables, freq, n, method, flow=flow)
    q = ensemble.fan(series.unpivot(["run_id", "rch", "date"], variables, "variable", "v"), ["rch", "variable"], "v")
    return view_statistics(q, pairing.at_sites(daily, sites), keys=["rch", "variable"], **options)
