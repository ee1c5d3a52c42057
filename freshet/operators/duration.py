"""Duration, exceedance and flow-stratified curves.

Ensemble curves rank the days of one reach, at most one row per calendar day and reach.
Curves over values that grow with the data use the exact distributed rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.order import exact_rank
from freshet.operators.select import threshold_fraction

LEVELS = tuple(range(1, 100))


def duration_curve(series: DataFrame, keys: Sequence[str], value: str, levels: Sequence[int] = LEVELS,
                   ascending: bool = False) -> DataFrame:
    """Value exceeded ``level`` % of the time; ascending reads the curve from its low end."""
    probs = [(level if ascending else 100 - level) / 100.0 for level in levels]
    q = F.percentile(value, F.array(*[F.lit(p) for p in probs]))
    got = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(q.alias("_q"))
    names = F.array(*[F.lit(int(x)) for x in levels])
    return (got.select(*keys, F.posexplode("_q").alias("_i", "value"))
            .select(*keys, F.element_at(names, F.col("_i") + 1).alias("level"), "value"))


def empirical_exceedance(df: DataFrame, keys: Sequence[str], value: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Exceedance in percent, 100 * rank / (n + 1), values from high to low."""
    out = exact_rank(df, keys, value, tiebreak, descending=True)
    return out.withColumn("exceedance", 100.0 * F.col("rank") / (F.col("n") + 1))


def band_duration_order(bands: DataFrame, keys: Sequence[str], columns: Sequence[str], levels: Sequence[int] = LEVELS,
                        ascending: bool = True) -> DataFrame:
    """Duration curve of every band column on its own (order statistics)."""
    long = bands.select(*keys, "date", F.explode(F.array(*[
        F.struct(F.lit(c).alias("band"), F.col(c).alias("v")) for c in columns])).alias("_b")).select(*keys, "_b.*")
    return duration_curve(long, [*keys, "band"], "v", levels, ascending)


def paired_duration(bands: DataFrame, keys: Sequence[str], ref: str = "p50",
                    columns: Sequence[str] = ("min", "p05", "p25", "p50", "p75", "p95", "max")) -> DataFrame:
    """Days ordered by a reference series, high to low; the bands keep their day.

    ``ref`` names a column, or "mid" for the middle of min and max. Equal sums of doubles differ in their last digits, so days whose
    references agree in fourteen digits are ties, in the order of their dates.
    """
    order = F.format_string("%.13E", (F.col("min") + F.col("max")) / 2 if ref == "mid" else F.col(ref)).cast("double")
    full = bands.withColumn("_ref", order).where(
        F.col("min").isNotNull() & F.col("max").isNotNull() & F.col("_ref").isNotNull())
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.col("_ref").desc(), "date"))
    return (full.withColumn("rank", rank).withColumn("n", F.count(F.lit(1)).over(w))
            .withColumn("x", 100.0 * F.col("rank") / (F.col("n") + 1))
            .select(*keys, "date", "rank", "x", *columns))


def measured_on_paired(daily: DataFrame, paired: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples at the rank of their day in the curve of their own keys."""
    return daily.where(F.col("obs").isNotNull()).join(paired.select(*by, "date", "x"), [*by, "date"])


def measured_on_order(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Samples at their own rank, values from low to high."""
    out = exact_rank(daily, keys, "obs", ["date", "station", "analyte"])
    return out.withColumn("x", 100.0 * F.col("rank") / (F.col("n") + 1))


def flow_stratified(
    loads: DataFrame, flow: DataFrame, keys: Sequence[str] = (), threshold: float | str = "p75", bin_step: float = 0.05,
    event_days: DataFrame | None = None,
) -> DataFrame:
    """Median load band per flow-exceedance bin, apart for event and other days.

    ``loads`` has (date, l_min, l_mean, l_max), ``flow`` has (date, flow_m3d). The regime comes
    from the flow threshold, or from ``event_days`` (date, is_event). Bins close on the right.
    Fewer than five days give no curve. Flow and event days are those of a key where they carry it, else of all series.
    """
    keys = list(keys)
    of_flow = [*[k for k in keys if k in flow.columns], "date"]
    trio = F.array_sort(F.array("l_min", "l_mean", "l_max"))
    days = (
        loads.join(flow, of_flow)
        .where(F.col("l_min").isNotNull() & F.col("l_mean").isNotNull() & F.col("l_max").isNotNull()
               & F.col("flow_m3d").isNotNull())
        .withColumn("_t", trio)
        .select(*keys, "date", "flow_m3d", F.col("_t")[0].alias("l_min"), F.col("_t")[1].alias("l_mean"),
                F.col("_t")[2].alias("l_max"))
    )
    if event_days is not None:
        on = [*[k for k in keys if k in event_days.columns], "date"]
        marks = event_days.where("is_event").select(*on, F.lit(True).alias("_e"))
        days = days.join(marks, on, "left").withColumn("_event", F.coalesce("_e", F.lit(False))).drop("_e")
    elif isinstance(threshold, str):
        cut = days.groupBy(*keys).agg(F.percentile("flow_m3d", F.lit(threshold_fraction(threshold))).alias("_cut"))
        days = days.join(cut, keys) if keys else days.withColumn("_cut", cut.scalar())
        days = days.withColumn("_event", F.col("flow_m3d") >= F.col("_cut"))
    else:
        days = days.withColumn("_event", F.col("flow_m3d") >= float(threshold))
    w = Window.partitionBy(*keys)
    ranked = (
        days.withColumn("rank", F.row_number().over(w.orderBy(F.col("flow_m3d").desc(), "date")))
        .withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= 5)
        .withColumn("exceedance", F.col("rank") / (F.col("n") + 1.0))
        .withColumn("regime", F.when(F.col("_event"), "event").otherwise("non-event"))
    )
    if bin_step <= 0:
        return ranked.select(*keys, F.col("exceedance").alias("x_mid"), "regime", F.col("l_min").alias("y_min"),
                             F.col("l_mean").alias("y_mean"), F.col("l_max").alias("y_max"))
    right = F.ceil(F.round(F.col("exceedance") / bin_step, 9))
    half = F.lit(0.5)
    return (
        ranked.withColumn("x_mid", F.round((right - 0.5) * bin_step, 9))
        .groupBy(*keys, "x_mid", "regime")
        .agg(F.percentile("l_min", half).alias("y_min"), F.percentile("l_mean", half).alias("y_mean"),
             F.percentile("l_max", half).alias("y_max"), F.count(F.lit(1)).alias("n_days"))
    )


def choose_flow(external: DataFrame | None, model: DataFrame | None, prefer: str = "auto") -> DataFrame | None:
    """Flow to stratify by: the preferred source when present, else the model, else the gauge."""
    sources = {"external": external, "model": model}
    if sources.get(prefer) is not None:
        return sources[prefer]
    return model if model is not None else external


def stratified_total(curve: DataFrame, keys: Sequence[str] = (), mode: str = "median") -> DataFrame:
    """Both regimes of a stratified curve in one: their median, or their outer extents."""
    half = F.lit(0.5)
    lo = F.min("y_min") if mode == "extents" else F.percentile("y_min", half)
    hi = F.max("y_max") if mode == "extents" else F.percentile("y_max", half)
    return curve.groupBy(*keys, "x_mid").agg(
        lo.alias("y_min"), F.percentile("y_mean", half).alias("y_mean"), hi.alias("y_max"))


def net_sediment_curve(sim: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Duration curve of sediment inflow minus outflow for the first run that has both."""
    net = sim.withColumn("net", F.col("sed_in") - F.col("sed_out")).where(F.col("net").isNotNull())
    first = net.groupBy("rch").agg(F.min("run_id").alias("run_id"))
    return duration_curve(net.join(first, ["rch", "run_id"]), ["rch"], "net", levels)
