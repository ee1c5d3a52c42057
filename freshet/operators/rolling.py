"""Rolling windows and climatology of daily series.

Windows run over one series at a time, at most one row per calendar day (or day of year).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.calendar import not_feb29
from freshet.operators.order import bounded_quantiles, exact_quantiles

BANDS = ["p10", "p25", "p75", "p90", "vmin", "vmax"]


def _median_of(values: Column) -> Column:
    a, n = F.array_sort(values), F.size(values)
    lo = F.try_element_at(a, F.floor((n + 1) / 2).cast("int"))
    hi = F.try_element_at(a, F.ceil((n + 1) / 2).cast("int"))
    return (lo + hi) / 2


def rolling(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], win: int | None, how: str = "mean") -> DataFrame:
    """Trailing window of ``win`` rows; NULL where fewer than half the window has values."""
    if win is None or win <= 1:
        return df
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(win - 1), 0)
    need = max(1, win // 2)
    out = {}
    for c in columns:
        value = F.avg(c).over(w) if how == "mean" else _median_of(F.collect_list(c).over(w))
        out[c] = F.when(F.count(c).over(w) >= need, value)
    return df.withColumns(out)


def _scope(df: DataFrame, reaches: Sequence[int] | None, years: Sequence[int] | None) -> DataFrame:
    if reaches:
        df = df.where(F.col("rch").isin(list(reaches)))
    if years:
        df = df.where(F.col("year").isin(list(years)))
    return df


def _center(df: DataFrame, keys: Sequence[str], agg: str, value: str, bounded: bool = False) -> DataFrame:
    """Mean or median per group; ``bounded`` groups are the reaches (and runs) of one day."""
    if agg == "mean" or bounded:
        f = F.avg(value) if agg == "mean" else F.percentile(value, F.lit(0.5))
        return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(f.alias("center"))
    return exact_quantiles(df, keys, value, {"center": 0.5})


def _bands(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    q = bounded_quantiles(F.col(value), [0.10, 0.25, 0.75, 0.90])
    return (df.where(F.col(value).isNotNull()).groupBy(*keys)
            .agg(q.alias("_q"), F.min(value).alias("vmin"), F.max(value).alias("vmax"))
            .select(*keys, F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p25"), F.col("_q")[2].alias("p75"),
                    F.col("_q")[3].alias("p90"), "vmin", "vmax"))


def _smooth(df: DataFrame, keys: Sequence[str], order: str, agg: str, roll: int) -> DataFrame:
    return rolling(rolling(df, keys, order, ["center"], roll, agg), keys, order, [c for c in BANDS if c in df.columns], roll)


def climatology(df: DataFrame, reaches: Sequence[int] | None = None, years: Sequence[int] | None = None, agg: str = "mean",
                roll: int = 1, keys: Sequence[str] = (), value: str = "metric") -> DataFrame:
    """Day-of-year centre line and the spread of its (year, reach) means."""
    keys = list(keys)
    s = _scope(df, reaches, years)
    center = _center(s, [*keys, "doy"], agg, value)
    means = s.groupBy(*keys, "doy", "year", "rch").agg(F.avg(value).alias(value))
    out = center.join(_bands(means, [*keys, "doy"], value), [*keys, "doy"], "left")
    return _smooth(out, keys, "doy", agg, roll)


def time_aggregate(df: DataFrame, reaches: Sequence[int] | None = None, years: Sequence[int] | None = None, agg: str = "mean",
                   roll: int = 1, keys: Sequence[str] = (), value: str = "metric") -> DataFrame:
    """Daily centre line across reaches and the spread of the reach means."""
    keys = list(keys)
    s = _scope(df, reaches, years)
    center = _center(s, [*keys, "date"], agg, value, True)
    means = s.groupBy(*keys, "date", "rch").agg(F.avg(value).alias(value))
    out = center.join(_bands(means, [*keys, "date"], value), [*keys, "date"], "left")
    return _smooth(out, keys, "date", agg, roll)


def years_overlay(df: DataFrame, reaches: Sequence[int] | None = None, agg: str = "mean", roll: int = 1,
                  keys: Sequence[str] = (), value: str = "metric") -> DataFrame:
    """One smoothed daily line per year."""
    keys = list(keys)
    line = _center(_scope(df, reaches, None), [*keys, "year", "date"], agg, value, True)
    return rolling(line, [*keys, "year"], "date", ["center"], roll, agg)


def year_reach(df: DataFrame, reaches: Sequence[int] | None = None, years: Sequence[int] | None = None,
               keys: Sequence[str] = (), value: str = "metric") -> DataFrame:
    return _scope(df, reaches, years).groupBy(*keys, "year", "rch").agg(F.avg(value).alias("delta"))


def all_years_line(df: DataFrame, reaches: Sequence[int] | None = None, agg: str = "mean", roll: int = 1,
                   keys: Sequence[str] = (), value: str = "metric") -> DataFrame:
    """Day-of-year line over all years and reaches."""
    keys = list(keys)
    return rolling(_center(_scope(df, reaches, None), [*keys, "doy"], agg, value), keys, "doy", ["center"], roll, agg)


def prepare_flow(flow: DataFrame, drop_leap_day: bool = False, value: str = "flow_m3d") -> DataFrame:
    out = flow.select(F.to_date("date").alias("date"), F.col(value).alias("flow"))
    if drop_leap_day:
        out = out.where(not_feb29("date"))
    return out.select("date", F.year("date").alias("year"), F.dayofyear("date").alias("doy"), "flow")


def flow_line(flow: DataFrame, by: str = "date", years: Sequence[int] | None = None, agg: str = "mean", roll: int = 1) -> DataFrame:
    """Smoothed flow per date, per day of year, or per date within each year (by = year)."""
    keys = ["year", "date"] if by == "year" else [by]
    line = _center(_scope(flow, None, years), keys, agg, "flow")
    return rolling(line, keys[:-1], keys[-1], ["center"], roll, agg)
