"""Calendar resampling, spines and period day counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.calendar import bucket, in_months
from freshet.functions.nulls import div

# fixed values: variables whose usual aggregation differs from the name rule
NAMED_HOW = {
    "BED_PSTmg": "mean",
    "BACTP_OUTct": "sum",
    "BACTLP_OUTct": "sum",
    "SEDCONCmg/L": "flow_weighted_mean",
    "NO3ConcMg/l": "flow_weighted_mean",
    "WTMPdegc": "flow_weighted_mean",
    "SAR": "flow_weighted_mean",
    "EC": "flow_weighted_mean",
    **{f"Salt{i}": "flow_weighted_mean" for i in range(1, 11)},
}


def default_how(variable: Column) -> Column:
    """Aggregation used when none is named: concentrations average, masses add up."""
    conc = variable.contains("Conc") | variable.contains("mg/L")
    mass = F.lower(variable).rlike("kg|tons|mg")
    return F.when(~conc & mass, F.lit("sum")).otherwise(F.lit("mean"))


def with_how(df: DataFrame, variable: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Attach ``how`` to each variable: the named override, else the name rule."""
    how = default_how(F.col(variable))
    for name, chosen in (overrides or {}).items():
        how = F.when(F.col(variable) == name, F.lit(chosen)).otherwise(how)
    return df.withColumn("how", how)


def resample(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], freq: str = "D", n: int = 1,
    how: str = "mean", flow: str | None = None, date: str = "date", origin: Column | None = None,
    clip_weights: bool = False,
) -> DataFrame:
    """Group rows of each series into calendar buckets; ``date`` becomes the bucket label.

    Buckets of several days, weeks, months or years start with the first day of each series, or with ``origin``, such as
    ``bucket_origin(df)``, which all series share. ``flow_weighted_mean`` divides by all flow of the bucket, also where the
    value is NULL.
    """
    if n > 1 and origin is None:
        df, origin = df.withColumn("_origin", _first_day(keys, date)), F.col("_origin")
    if how == "flow_weighted_mean" and flow is None:
        how = "mean"
    aggs = []
    for v in values:
        if how == "sum":
            aggs.append(F.sum(v).alias(v))
        elif how == "flow_weighted_mean":
            w = F.greatest(F.col(flow), F.lit(0.0)) if clip_weights else F.col(flow)
            aggs.append(div(F.sum(F.col(v) * w), F.sum(w)).alias(v))
        else:
            aggs.append(F.avg(v).alias(v))
    return (
        df.withColumn("_bucket", bucket(date, freq, n, origin))
        .groupBy(*keys, "_bucket").agg(*aggs)
        .withColumnRenamed("_bucket", "date")
    )


def _first_day(keys: Sequence[str], date: str) -> Column:
    return F.min(F.col(date).cast("date")).over(Window.partitionBy(*keys))


def spine(df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Every calendar day between the first and last day of each series."""
    d = F.col(date).cast("date")
    ends = df.groupBy(*keys).agg(F.min(d).alias("_a"), F.max(d).alias("_b"))
    return ends.where(F.col("_a").isNotNull()).select(*keys, F.explode(F.sequence("_a", "_b")).alias("date"))


def with_empty_buckets(out: DataFrame, source: DataFrame, keys: Sequence[str], freq: str, n: int = 1,
                       date: str = "date") -> DataFrame:
    """Add the buckets that hold no row, as NULL, so each series is complete over its span."""
    days = spine(source, keys, date)
    origin = None
    if n > 1:
        days, origin = days.withColumn("_origin", _first_day(keys, "date")), F.col("_origin")
    labels = days.select(*keys, bucket("date", freq, n, origin).alias("date")).distinct()
    return labels.join(out, [*keys, "date"], "left")


def period_day_counts(df: DataFrame, freq: str, months: Sequence[int] | None = None, n: int = 1) -> DataFrame:
    """Days per bucket between the first and last day of the frame; out-of-season days count 0."""
    days = spine(df)
    season = F.when(in_months("date", months), 1).otherwise(0)
    kept = days.where(in_months("date", months)) if months else days
    first, last = kept.agg(F.min("date")).scalar(), kept.agg(F.max("date")).scalar()
    origin = kept.agg(F.min("date")).scalar() if n > 1 else None
    return (
        days.where((F.col("date") >= first) & (F.col("date") <= last))
        .groupBy(bucket("date", freq, n, origin).alias("date"))
        .agg(F.sum(season).cast("double").alias("n_days"))
    )
