"""Filters and derived columns used ahead of every analysis."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.calendar import in_months, not_feb29
from freshet.functions.nulls import number


def reach(df: DataFrame, rch: int | Sequence[int], columns: Sequence[str]) -> DataFrame:
    wanted = [rch] if isinstance(rch, int) else list(rch)
    return df.where(F.col("rch").isin(wanted)).select(*columns)


def time_slice(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Rows between two days, both included; a missing side is open."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast(df.schema[date].dataType))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast(df.schema[date].dataType))
    return df


def season(df: DataFrame, months: Sequence[int] | None, date: str = "date") -> DataFrame:
    return df.where(in_months(date, months)) if months else df


def drop_feb29(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(not_feb29(date))


def kjeldahl(df: DataFrame, orgn: str = "orgn", nh4: str = "nh4", out: str = "kjeldahl") -> DataFrame:
    return df.withColumn(out, F.col(orgn) + F.col(nh4))


def net_sediment(df: DataFrame, sed_in: str = "sed_in", sed_out: str = "sed_out") -> DataFrame:
    return (df.withColumn("net_in_out", F.col(sed_in) - F.col(sed_out))
            .withColumn("net_out_in", F.col(sed_out) - F.col(sed_in)))


def area_hectares(df: DataFrame, area_km2: str = "area_km2", hectare_per_km2: float = 100.0) -> DataFrame:
    return df.withColumn("area_ha", F.col(area_km2) * F.lit(hectare_per_km2))


def clean_measured(
    df: DataFrame, value: str = "value", nonnum: str = "as_na", negative: str = "keep",
    half_mdl: float = 0.1, drop_missing_with_negative: bool = False, out: str = "value_num",
) -> DataFrame:
    """Apply the policies for unreadable and negative lab values.

    nonnum: as_na | drop | zero | half_MDL. negative: keep | drop | zero. With
    ``drop_missing_with_negative`` a negative policy of drop also removes missing values.
    """
    df = df.withColumn(out, number(value))
    v = F.col(out)
    if negative == "drop":
        df = df.where(v >= 0) if drop_missing_with_negative else df.where(v.isNull() | (v >= 0))
    elif negative == "zero":
        df = df.withColumn(out, F.when(v < 0, F.lit(0.0)).otherwise(v))
    if nonnum == "drop":
        return df.where(v.isNotNull())
    if nonnum == "zero":
        return df.withColumn(out, F.coalesce(v, F.lit(0.0)))
    if nonnum == "half_MDL":
        return df.withColumn(out, F.coalesce(v, F.lit(float(half_mdl))))
    return df


def threshold_fraction(token: str) -> float:
    """Fraction named by q1/q2/q3, q25/q50/q75, pNN, NNpct or NN."""
    # fixed values: quartile shortcuts
    quartiles = {"q1": 0.25, "q25": 0.25, "q2": 0.5, "q50": 0.5, "q3": 0.75, "q75": 0.75}
    t = str(token).strip().lower()
    if t in quartiles:
        return quartiles[t]
    m = re.fullmatch(r"p?(100|\d{1,2})(?:pct)?", t)
    if not m:
        raise ValueError(f"unknown threshold token {token!r}")
    return int(m.group(1)) / 100.0


# fixed values: name patterns of flow columns, weakest first; the first one found counts
FLOW_PATTERNS = ["m3s", "cms", "m3/day", "m3_d", "q", "q_m3", "caudal", "flow", "flow_m3_d", "water_flow_m3_d"]

NUMERIC = ("double", "float", "integer", "long", "short", "byte")


def flow_column(df: DataFrame, explicit: str | None = None) -> str | None:
    """Column to read flow from: the named one, else best name pattern, else the fullest."""
    if explicit in df.columns:
        return explicit
    candidates = [f.name for f in df.schema if f.dataType.typeName() in NUMERIC]
    candidates = candidates or [c for c in df.columns if c != "outliers"]

    def by_name(c: str) -> int:
        return next((i + 1 for i, p in enumerate(FLOW_PATTERNS) if p in c.lower()), 0)

    best = max(by_name(c) for c in candidates)
    candidates = [c for c in candidates if by_name(c) == best]
    if len(candidates) == 1:
        return candidates[0]
    filled = df.agg(*[F.count(c).alias(c) for c in candidates]).first()
    return max(candidates, key=lambda c: filled[c])


def model_flow_column(columns: Sequence[str]) -> str | None:
    """Model outflow column: the full name, the short name, then any spelling of it."""
    for name in ("FLOW_OUTcmscms", "FLOW_OUTcms", "FLOW_OUT"):
        if name in columns:
            return name
    return next((c for c in columns if c.lower().startswith("flow_out")), None)


def value_column(df: DataFrame, known: Sequence[str], exclude: Sequence[str]) -> str | None:
    """Measured value column: first known name present, else the first other numeric column."""
    for c in known:
        if c in df.columns:
            return c
    for f in df.schema:
        if f.name not in exclude and f.dataType.typeName() in NUMERIC:
            return f.name
    return None


def sediment_pair(columns: Sequence[str]) -> tuple[str, str] | None:
    """Names of the sediment inflow and outflow columns: with unit, plain, then any spelling."""
    low = {c.lower(): c for c in columns}
    for tail in ("tons", ""):
        if f"sed_in{tail}" in low and f"sed_out{tail}" in low:
            return low[f"sed_in{tail}"], low[f"sed_out{tail}"]
    found = [next((c for c in columns if s in c.lower() and "tons" in c.lower()), None) for s in ("sed_in", "sed_out")]
    return (found[0], found[1]) if all(found) else None


def filled_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-missing cells per column in one pass, the tie-break between candidate columns."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in columns]))
    return df.agg(*[F.count(c).alias(c) for c in columns]).select(pairs.alias("p")).select("p.*")


def reach_list(df: DataFrame) -> DataFrame:
    return df.groupBy("rch").agg(F.count_distinct("run_id").alias("n_runs"))


def station_lookup(measured: DataFrame) -> DataFrame:
    return (measured.where(F.col("analyte").isNotNull() & F.col("station").isNotNull())
            .groupBy("analyte").agg(F.sort_array(F.collect_set("station")).alias("stations")))


def lag_rows(df: DataFrame, keys: Sequence[str], value: str, by: int, date: str = "date", out: str = "lagged") -> DataFrame:
    """Shift a daily series by rows, either sign."""
    w = Window.partitionBy(*keys).orderBy(date)
    return df.withColumn(out, F.lag(value, by).over(w))


