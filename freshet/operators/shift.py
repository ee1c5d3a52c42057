"""Scenario shifts against the ensemble baseline (delta = baseline - scenario).

Every scenario is a daily series, so the groups here hold at most one row per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.nulls import div
from freshet.operators.fit import _attach, core_metrics


def _median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def _p90(c: Column) -> Column:
    return F.percentile(c, F.lit(0.9))


def with_deltas(pairs: DataFrame) -> DataFrame:
    """Attach delta, relative width and percent shift to (base, overlay) pairs."""
    delta = F.col("base") - F.col("overlay")
    return (pairs.withColumn("delta", delta)
            .withColumn("rel", div(F.abs(delta), F.abs("base")))
            .withColumn("pct", div(delta, F.abs("base")) * 100))


def shift_set(pairs: DataFrame, keys: Sequence[str] = ("scenario",), agg: str = "median") -> DataFrame:
    """Shift summary per scenario; agg is median, mean or both."""
    p = with_deltas(pairs)
    b, o = F.col("base"), F.col("overlay")
    center = F.avg if agg == "mean" else _median
    s = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        center(F.col("delta")).alias("median_delta"), center(F.col("pct")).alias("median_delta_pct"),
        F.avg("delta").alias("mean_delta"), F.avg("pct").alias("mean_delta_pct"),
        _median(F.col("rel")).alias("relative_width"),
        F.min(b).alias("baseline_min"), F.max(b).alias("baseline_max"), F.avg(b).alias("baseline_mean"),
        _median(b).alias("baseline_p50"), _p90(b).alias("baseline_p90"),
        F.min(o).alias("overlay_min"), F.max(o).alias("overlay_max"), F.avg(o).alias("overlay_mean"),
        _median(o).alias("overlay_p50"), _p90(o).alias("overlay_p90"),
    )
    for stat in ("min", "max", "mean", "p50", "p90"):
        s = s.withColumn(f"delta_{stat}", F.col(f"baseline_{stat}") - F.col(f"overlay_{stat}"))
    s = s.withColumn("normalized_median_delta", div("median_delta", "baseline_p50"))
    s = s.withColumn("normalized_mean_delta", div("mean_delta", "baseline_mean"))
    if agg == "median":
        s = s.drop("mean_delta", "mean_delta_pct", "normalized_mean_delta")
    fit = core_metrics(p, keys, "overlay", "base", agreement=False).select(*keys, "rmse", "r")
    return _attach(s, fit, keys)


def overlay_metrics(pairs: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """r, R2, MAE, RMSE, bias and median absolute error of scenario against baseline."""
    fit = core_metrics(pairs, keys, "overlay", "base", agreement=False).select(*keys, "n", "r", "r2", "mae", "rmse", "bias")
    med = pairs.groupBy(*keys).agg(_median(F.abs(F.col("overlay") - F.col("base"))).alias("medae"))
    return _attach(fit, med, keys).withColumnRenamed("n", "n_pairs")


def stratified_widths(pairs: DataFrame, baseline: DataFrame, base: str = "p50", keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """Relative width on days with a low (<= q10) and high (>= q90) baseline of their series, and their ratio."""
    by = [k for k in keys if k in baseline.columns]
    q = baseline.groupBy(*by).agg(F.percentile(base, F.array(F.lit(0.1), F.lit(0.9))).alias("_q"))
    p = _attach(with_deltas(pairs), q, by)
    s = p.groupBy(*keys).agg(
        _median(F.when(F.col("base") <= F.col("_q")[0], F.col("rel"))).alias("relative_width_low"),
        _median(F.when(F.col("base") >= F.col("_q")[1], F.col("rel"))).alias("relative_width_high"))
    return s.withColumn("relative_width_event_contrast", div("relative_width_high", "relative_width_low"))


def event_shift(pairs: DataFrame, days: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """Widths, pair counts and shifts on event days (``is_buffered``) against other days."""
    on = [*[k for k in keys if k in days.columns], "date"]
    p = with_deltas(pairs).join(days.select(*on, "is_buffered"), on, "left")
    ev = F.coalesce(F.col("is_buffered"), F.lit(False))
    known = F.col("is_buffered").isNotNull()
    non = known & ~ev
    rel, delta = F.col("rel"), F.col("delta")
    s = p.groupBy(*keys).agg(
        _median(F.when(ev, rel)).alias("relative_width_event"),
        _median(F.when(non, rel)).alias("relative_width_nonevent"),
        F.count(F.when(ev, rel)).alias("event_pairs"), F.count(F.when(non, rel)).alias("non_event_pairs"),
        _median(F.when(ev, delta)).alias("delta_event_pairs"),
        _median(F.when(non, delta)).alias("delta_non_event_pairs"),
        F.avg(F.when(ev, delta)).alias("delta_event_pairs_mean"),
        F.avg(F.when(non, delta)).alias("delta_non_event_pairs_mean"))
    return s.withColumn("event_ratio", div("relative_width_event", "relative_width_nonevent"))


def envelope_widths(pairs: DataFrame, bands: DataFrame, value: str = "overlay", keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """Width of the ensemble envelope on the paired days and share of the series inside it."""
    on = [*[k for k in keys if k in bands.columns], "date"]
    p = pairs.join(bands.select(*on, F.col("min").alias("_a"), F.col("max").alias("_b")), on, "left")
    width = F.abs(F.col("_b") - F.col("_a"))
    v = F.col(value)
    ok = v.isNotNull() & width.isNotNull()
    inside = (v >= F.least("_a", "_b")) & (v <= F.greatest("_a", "_b"))
    return p.groupBy(*keys).agg(
        _median(width).alias("median_w"), F.avg(width).alias("mean_w"), _p90(width).alias("p90_w"),
        F.avg(F.when(ok, F.when(inside, 1.0).otherwise(0.0))).alias("coverage_fraction"))


def baseline_summary(bands: DataFrame, base: str = "p50", keys: Sequence[str] = ()) -> DataFrame:
    """Median, mean and sd of the baseline and its p05-p95 width relative to its size."""
    v = F.col(base)
    rel = div(F.col("p95") - F.col("p05"), F.abs(v))
    return bands.where(v.isNotNull()).groupBy(*keys).agg(
        _median(v).alias("median"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
        _median(rel).alias("relative_width"), F.avg(rel).alias("relative_width_mean"))


def metric_matrix(values: DataFrame, scenarios: DataFrame, metrics: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """A row per metric and scenario with one column per variable, and the names of missing cells.

    ``values`` holds (metric, scenario, variable, value).
    """
    grid = scenarios.select("scenario").distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    wide = values.groupBy("metric", "scenario").pivot("variable", list(variables)).agg(F.first("value", True))
    missing = F.array_compact(F.array(*[F.when(F.col(v).isNull(), F.lit(v)) for v in variables]))
    return (grid.join(wide, ["metric", "scenario"], "left")
            .withColumn("missing", F.array_join(missing, ",")))
