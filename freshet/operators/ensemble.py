"""Aggregates over the runs of an ensemble.

Group sizes here are bounded by the number of runs: a reach has one row per run and day.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.order import quantile_of
from freshet.operators.resample import resample

SECONDS_PER_DAY = 86400.0

# fixed values: the percentiles of a fan
FAN_PERCENTILES = (5, 10, 25, 50, 60, 75, 90, 95)
BAND_PERCENTILES = (5, 25, 50, 75, 95)


def _name(p: int) -> str:
    return f"p{p:02d}"


def fan_state(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, date, values, total): the sorted values of all runs for each key and day, from which any fan follows.

    Stored, it takes in later runs by ``merge_states`` without the rows of the earlier ones. A run must not be added twice.
    """
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, "date")
            .agg(F.sort_array(F.collect_list(value)).alias("values"), F.sum(value).alias("total")))


def merge_states(states: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One state out of several of different runs."""
    both = reduce(DataFrame.unionByName, states)
    return both.groupBy(*keys, "date").agg(F.sort_array(F.flatten(F.collect_list("values"))).alias("values"), F.sum("total").alias("total"))


def fan_of(state: DataFrame, keys: Sequence[str], percentiles: Sequence[int] = FAN_PERCENTILES) -> DataFrame:
    """The fan of a stored state."""
    picks = [quantile_of("values", p / 100.0).alias(_name(p)) for p in percentiles]
    n = F.size("values").cast("long")
    return state.select(*keys, "date", F.get("values", F.lit(0)).alias("min"), *picks, F.element_at("values", -1).alias("max"), (F.col("total") / n).alias("mean"), n.alias("n_values"))


def fan(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[int] = FAN_PERCENTILES) -> DataFrame:
    """min, max, mean and percentiles across runs for each key and day.

    One value per run is gathered and sorted once for all percentiles; on 20 million rows
    this takes little over half the time of ``percentile``.
    """
    g = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, "date")
        .agg(F.sort_array(F.collect_list(value)).alias("_v"), F.avg(value).alias("mean"), F.count(value).alias("n_values"))
    )
    picks = [quantile_of("_v", p / 100.0).alias(_name(p)) for p in percentiles]
    return g.select(*keys, "date", F.get("_v", F.lit(0)).alias("min"), *picks, F.element_at("_v", -1).alias("max"), "mean", "n_values")


def bands(df: DataFrame, keys: Sequence[str], value: str, event_filter: bool = False, n_runs: int | None = None) -> DataFrame:
    """Fan rows kept where at least half the runs (any run under an event filter) have data.

    Without ``n_runs`` the runs are counted, which reads the ensemble a second time.
    """
    out = fan(df, keys, value, BAND_PERCENTILES)
    if event_filter:
        return out
    runs = df.agg(F.count_distinct("run_id")).scalar() if n_runs is None else F.lit(n_runs)
    return out.where(F.col("n_values") >= F.greatest(F.lit(1), F.floor(runs / 2)))


def mean_daily_flow(sim: DataFrame, flow: str = "flow_cms") -> DataFrame:
    """Model flow in m3/day: summed per run and day, then averaged over runs."""
    return (
        sim.groupBy("rch", "run_id", "date").agg(F.sum(F.col(flow) * SECONDS_PER_DAY).alias("q"))
        .groupBy("rch", "date").agg(F.avg("q").alias("flow_m3d"))
    )


def external_daily_flow(flow: DataFrame, how: str = "sum", value: str = "flow_m3d") -> DataFrame:
    """Gauge flow with one row per day: duplicates add up, or average for load conversion."""
    agg = F.avg(value) if how == "mean" else F.sum(value)
    return flow.groupBy(F.col("date").cast("date").alias("date")).agg(agg.alias("flow_m3d"))


def erosion(sim: DataFrame, freq: str = "M", n: int = 1, how: str = "sum") -> DataFrame:
    """Mean over runs of the resampled sediment inflow minus outflow."""
    net = sim.select("run_id", "rch", "date", (F.col("sed_in") - F.col("sed_out")).alias("net"))
    return (resample(net, ["run_id", "rch"], ["net"], freq, n, how)
            .groupBy("rch", "date").agg(F.avg("net").alias("erosion")))


def scenario_series(frames: DataFrame, keys: Sequence[str], value: str, freq: str, n: int = 1, how: str = "sum") -> DataFrame:
    """Resampled series of extra frames, one per ``scenario``, kept apart from the fan."""
    return resample(frames, ["scenario", *keys], [value], freq, n, how)


def relative_bands(band: DataFrame, series: DataFrame, on: Sequence[str], names: Sequence[str],
                   center: str = "value", columns: Sequence[str] = ("min", "p05", "p25", "p50", "p75", "p95", "max")) -> DataFrame:
    """Bands of the ensemble moved onto another series: series + (band - ensemble mean)."""
    shifted = [(F.col(center) + (F.col(c) - F.col("mean"))).alias(c) for c in columns]
    return (series.join(band, list(on), "left")
            .select(*names, *on, F.col(center).alias("mean"), *shifted))


def sanitise(name):
    """Series label: runs of other characters become one underscore, lower case."""
    clean = F.lower(F.trim(F.regexp_replace(name, "[^0-9A-Za-z]+", "_"), F.lit("_")))
    return F.when(F.length(clean) > 0, clean).otherwise(F.lit("series"))
