"""Channel mass balance of sediment and nutrients: reach output against sub-basin yield."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.calendar import not_feb29
from freshet.functions.nulls import div
from freshet.operators.resample import resample
from freshet.operators.rolling import rolling

# fixed values: per day and cubic metre per second to mg/L, from tonnes and from kg
TONS_TO_MGL = 11.574074
KG_TO_MGL = 0.011574074


def join_sub(reach: DataFrame, sub: DataFrame) -> DataFrame:
    """Reach rows with the yield of the sub-basin of the same number on the same day."""
    return reach.join(sub.withColumnRenamed("sub", "rch"), ["rch", "date"])


def with_delivery_ratio(df: DataFrame, ratio: float | DataFrame) -> DataFrame:
    """Attach ``dr``: one number, or a table keyed by reach or by (date, reach)."""
    if isinstance(ratio, DataFrame):
        on = [c for c in ("date", "rch") if c in ratio.columns]
        return df.join(ratio.select(*on, F.col("dr").cast("double").alias("dr")), on, "left")
    return df.withColumn("dr", F.lit(float(ratio)))


def _total(*names: str) -> Column:
    out = F.coalesce(F.col(names[0]), F.lit(0.0))
    for n in names[1:]:
        out = out + F.coalesce(F.col(n), F.lit(0.0))
    return out


def channel_balance(
    reach: DataFrame, sub: DataFrame, constituent: str = "SED", method: str = "A", dr: float | DataFrame = 1.0,
    dr_particulate: float = 0.7, dr_dissolved: float = 0.95, drop_leap_day: bool = False, keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Change in the channel per day and reach.

    A: (out - in) - local delivery. B: the opposite. C1: A per discharge in mg/L. C2: A per mm
    of runoff and hectare. Constituents: SED in tonnes, TP and TN in kg. The delivery ratio
    ``dr`` applies to sediment; the other two to particulate and dissolved nutrients.
    """
    constituent, method = constituent.upper(), method.upper()
    m = join_sub(reach, sub)
    ha = F.col("area_km2") * 100.0
    if constituent == "SED":
        m = with_delivery_ratio(m, dr)
        gain = F.col("sed_out") - F.col("sed_in")
        local = F.col("dr") * (F.col("syld") * ha)
        to_mgl, per_runoff = TONS_TO_MGL, 1000.0
    elif constituent == "TP":
        gain = _total("orgp_out", "minp_out") - _total("orgp_in", "minp_in")
        local = (_total("orgp", "sedp") * dr_particulate + _total("solp") * dr_dissolved) * ha
        to_mgl, per_runoff = KG_TO_MGL, 1.0
    elif constituent == "TN":
        gain = _total("orgn_out", "no3_out", "nh4_out", "no2_out") - _total("orgn_in", "no3_in", "nh4_in", "no2_in")
        local = (_total("orgn") * dr_particulate + _total("nsurq") * dr_dissolved) * ha
        to_mgl, per_runoff = KG_TO_MGL, 1.0
    else:
        raise ValueError(f"unknown constituent {constituent!r}")
    delta = gain - local
    if method not in ("A", "B", "C1", "C2"):
        raise ValueError(f"unknown method {method!r}")
    metric = {
        "A": delta, "B": -delta, "C1": div(delta * to_mgl, "flow_cms"),
        "C2": div(delta * per_runoff, F.col("wyld") * ha),
    }[method]
    out = m.select(*keys, "date", "rch", F.year("date").alias("year"), F.dayofyear("date").alias("doy"), metric.alias("metric"))
    return out.where(not_feb29("date")) if drop_leap_day else out


def nutrient_comparison(
    reach: DataFrame, sub: DataFrame, reaches: Sequence[int], agg: str = "sum", freq: str | None = None,
    resample_how: str = "sum", roll: int | None = None, keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """TN and TP over reaches three ways: component sums, reported totals, area-scaled yields.

    The sub-basin area counts as km2 when its median is below 1000, else as hectares.
    """
    f = F.sum if agg == "sum" else F.avg
    keys = list(keys)
    r = (
        reach.where(F.col("rch").isin(list(reaches)))
        .withColumn("tn_components", _total("orgn_out", "no3_out", "nh4_out", "no2_out"))
        .withColumn("tp_components", _total("orgp_out", "minp_out"))
        .groupBy(*keys, "date").agg(*[f(c).alias(c) for c in ("tn_components", "tp_components", "tot_n", "tot_p")])
    )
    s = sub.where(F.col("sub").isin(list(reaches)))
    # a sub-basin has one area, so its median over sub-basins needs one row each
    km2 = s.groupBy("sub").agg(F.avg("area_km2").alias("a")).agg(F.percentile("a", F.lit(0.5))).scalar() < 1000
    ha = F.col("area_km2") * F.when(km2, 100.0).otherwise(1.0)
    y = (
        s.withColumn("tn_yield", _total("orgn", "nsurq") * ha).withColumn("tp_yield", _total("orgp", "solp", "sedp") * ha)
        .groupBy("date").agg(f("tn_yield").alias("tn_yield"), f("tp_yield").alias("tp_yield"))
    )
    cols = ["tn_components", "tp_components", "tot_n", "tot_p", "tn_yield", "tp_yield"]
    out = r.join(y, "date")
    if freq:
        out = resample(out, keys, cols, freq, 1, resample_how)
    if roll and roll > 1:
        out = rolling(out, keys, "date", cols, roll)
    return out.select(*keys, "date", *cols)
