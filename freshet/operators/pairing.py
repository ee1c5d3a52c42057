"""Joins between sparse lab samples, gauge flow and model series.

Samples are the side that grows. They learn which reach and model variable they stand for from a table of sites, joined as
data, and meet the series of their own reach and variable (``by``) on their day. Spark measures the series and sends
them to the samples where they are small; otherwise both sides are shuffled by the keys. No size is assumed here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.calendar import in_months
from freshet.functions.nulls import div, number
from freshet.functions.sums import steady_mean
from freshet.operators.ensemble import SECONDS_PER_DAY, external_daily_flow
from freshet.operators.resample import period_day_counts, resample

KG_PER_DAY = 0.001  # mg/L times m3/day to kg/day


def samples_to_load(
    samples: DataFrame, flow: DataFrame, nonnum: str = "as_na", negative: str = "zero", half_mdl: float = 0.1,
) -> DataFrame:
    """Concentration samples to kg/day with the mean gauge flow of their day."""
    s = samples.withColumn("date", F.to_date("date"))
    s = s.withColumn("conc", number("value"))
    if negative == "drop":
        s = s.where(F.col("conc") >= 0)
    elif negative == "zero":
        s = s.withColumn("conc", F.when(F.col("conc") < 0, F.lit(0.0)).otherwise(F.col("conc")))
    daily = external_daily_flow(flow, "mean")
    joined = s.join(daily, "date", "left")
    if nonnum == "drop":
        joined = joined.where(F.col("conc").isNotNull() & F.col("flow_m3d").isNotNull())
    elif nonnum in ("zero", "half_MDL"):
        joined = joined.withColumn("conc", F.coalesce("conc", F.lit(half_mdl if nonnum == "half_MDL" else 0.0)))
    return joined.withColumn("kg_per_day", F.col("conc") * F.col("flow_m3d") * KG_PER_DAY)


def load_to_concentration(sim: DataFrame, load: str, flow: DataFrame | None = None, own_flow: bool = True) -> DataFrame:
    """mg/L from kg/day; flow from the given daily table, else the run's own outflow."""
    q: Column
    if flow is not None:
        sim = sim.join(flow.withColumnRenamed("flow_m3d", "_q"), [c for c in ("rch", "date") if c in flow.columns], "left")
        q = F.coalesce("_q", F.col("flow_cms") * SECONDS_PER_DAY) if own_flow else F.col("_q")
    else:
        q = F.col("flow_cms") * SECONDS_PER_DAY
    return sim.withColumn("conc_mgl", div(F.col(load), q) / KG_PER_DAY).drop("_q")


def measured_daily(
    measured: DataFrame, value: str = "value_num", analytes: Sequence[str] | None = None,
    stations: Sequence[str] | None = None, start: str | None = None, end: str | None = None,
    months: Sequence[int] | None = None,
) -> DataFrame:
    """Mean per station, analyte and day under name, station, time and season filters."""
    m = measured
    if analytes:
        m = m.where(F.col("analyte").isin(list(analytes)))
    if stations:
        m = m.where(F.col("station").isin(list(stations)))
    if start is not None:
        m = m.where(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        m = m.where(F.col("date") <= F.lit(end).cast("timestamp_ntz"))
    if months:
        m = m.where(in_months("date", months))
    return m.groupBy("station", "analyte", F.to_date("date").alias("date")).agg(steady_mean(value).alias("obs"))


def measured_period_total(daily: DataFrame, freq: str, months: Sequence[int] | None = None, n: int = 1) -> DataFrame:
    """Estimated total of a period: mean of its samples times its days."""
    means = resample(daily, ["station", "analyte"], ["obs"], freq, n, "mean")
    days = period_day_counts(daily.select("date"), freq, months, n)
    return means.join(days, "date").withColumn("obs_total", F.col("obs") * F.col("n_days"))


def pair_same_day(daily: DataFrame, q: DataFrame, pred: str = "p50", start: str | None = None, end: str | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """Observed and predicted on the same day, both present; every station stays a row.

    ``by`` (such as rch and variable) names the keys that samples and series share; without it ``q`` is one series by date.
    """
    if start is not None:
        daily = daily.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        daily = daily.where(F.col("date") <= F.lit(end).cast("date"))
    return (daily.join(q, [*by, "date"]).where(F.col("obs").isNotNull() & F.col(pred).isNotNull())
            .withColumn("pred", F.col(pred)))


def neighbourhood(series: DataFrame, k: int, columns: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """For every day within k days of a series row: those rows, as an array (at most 2k + 1).

    Built from the series, which has one row per day, so that the samples, the side that
    grows, are joined once on their own day and neither copied nor grouped.
    """
    row = F.struct(F.col("date").alias("model_date"), *columns).alias("row")
    days = F.explode(F.sequence(F.date_sub("date", k), F.date_add("date", k)))
    return (series.select(*by, row, days.alias("day")).groupBy(*by, F.col("day").alias("date"))
            .agg(F.collect_list("row").alias("_near")))


def match_local_window(daily: DataFrame, series: DataFrame, k: int = 1, strategy: str = "nearest", pred: str = "p50", by: Sequence[str] = ()) -> DataFrame:
    """Model value for each sample within k days: nearest in value (earliest on ties) or the mean."""
    near = neighbourhood(series.where(F.col(pred).isNotNull()), k, [F.col(pred).alias("m")], by)
    rows = daily.where(F.col("obs").isNotNull()).join(near, [*by, "date"])
    if strategy == "mean":
        total = F.aggregate("_near", F.lit(0.0), lambda acc, r: acc + r["m"])
        return rows.withColumn("pred", total / F.size("_near")).withColumn("k_days", F.lit(0)).drop("_near")
    best = F.array_min(F.transform("_near", lambda r: F.struct(F.abs(r["m"] - F.col("obs")).alias("gap"), r["model_date"], r["m"])))
    return (rows.withColumn("_b", best).withColumn("pred", F.col("_b.m"))
            .withColumn("k_days", F.datediff("_b.model_date", "date")).drop("_near", "_b"))


def match_nearest_day(daily: DataFrame, series: DataFrame, columns: Sequence[str], tolerance: int = 1,
                      by: Sequence[str] = ()) -> DataFrame:
    """Series row nearest in time within a tolerance of days; the later day wins a tie.

    ``by`` tells several series apart. A sample that carries such a key meets the series of its own key only, and each
    series of those it doesn't carry.
    """
    near = neighbourhood(series, tolerance, columns, by)
    shared = [k for k in by if k in daily.columns]
    rows = daily.where(F.col("obs").isNotNull()).join(near, [*shared, "date"])

    def order(r: Column) -> Column:
        apart = F.datediff(r["model_date"], "date")
        return F.struct(F.abs(apart).alias("gap"), (-apart).alias("later"), r.alias("row"))

    return rows.withColumn("_b", F.array_min(F.transform("_near", order))).select(
        *[k for k in by if k not in shared], *daily.columns, "_b.row.*")


def pair_scenarios(scenarios: DataFrame, baseline: DataFrame, base: str = "p50", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Scenario series against the baseline of their keys on shared days, both present."""
    return (scenarios.join(baseline.select(*by, "date", F.col(base).alias("base")), [*by, "date"])
            .where(F.col(value).isNotNull() & F.col("base").isNotNull())
            .withColumnRenamed(value, "overlay"))


def _parts(name: Column) -> Column:
    """Every distinct part of a short name."""
    n = F.length(name)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), n - i + 1), lambda size: F.substring(name, i, size)))))


def resolve_proxies(mapping: DataFrame, variables: DataFrame, top: int = 3) -> DataFrame:
    """(variable, category, analyte, weight): what stands in for each model variable, as a table.

    ``mapping`` has (entry, pos, weight, analyte), pos being an entry's place in the map; ``variables`` has (variable). An entry
    is found by exact name, then ignoring case, then by either name holding the other; of several the first in the map
    counts. Weights 1 to 3 alone are categories; other weights are ranked, of which the heaviest ``top`` count.
    """
    entries = mapping.select("entry", "pos", F.lower(F.trim("entry")).alias("low")).distinct().where("low <> ''")
    names = variables.select("variable", F.lower(F.trim("variable")).alias("own")).distinct().where("own <> ''")
    held = names.select("variable", "own", F.explode(_parts(F.col("own"))).alias("low")).join(entries, "low")
    holding = entries.select("entry", "pos", "low", F.explode(_parts(F.col("low"))).alias("own")).join(names, "own")
    how = F.when(F.col("entry") == F.col("variable"), 0).when(F.col("low") == F.col("own"), 1).otherwise(2)
    found = held.select("variable", "entry", "pos", "low", "own").unionByName(holding.select("variable", "entry", "pos", "low", "own"))
    chosen = found.groupBy("variable").agg(F.min(F.struct(how.alias("how"), "pos", "entry")).alias("b")).select("variable", "b.entry")
    of_entry = Window.partitionBy("entry")  # the few rows of one map entry
    ranked = (mapping.withColumn("_plain", F.min(F.col("weight").isin(1, 2, 3)).over(of_entry))
              .withColumn("_rank", F.dense_rank().over(of_entry.orderBy(F.col("weight").desc()))))
    kept = ranked.where(F.col("_plain") | (F.col("_rank") <= top))
    category = F.when(F.col("_plain"), F.col("weight")).otherwise(F.col("_rank")).cast("int")
    return chosen.join(kept, "entry").select("variable", category.alias("category"), "analyte", "weight")


def at_sites(daily: DataFrame, sites: DataFrame) -> DataFrame:
    """Samples with the reach and model variable that they stand for; ``sites`` has (station, analyte, rch, variable)."""
    return daily.join(sites.select("station", "analyte", "rch", "variable"), ["station", "analyte"])


def proxies(mapping: DataFrame, variables: DataFrame, measured: DataFrame) -> DataFrame:
    """Proxy analytes of each variable that occur among the samples, with their sample counts."""
    counts = measured.groupBy("analyte").agg(F.count(F.lit(1)).alias("n_samples"))
    return resolve_proxies(mapping, variables).join(counts, "analyte")


def flag_deviation(daily: DataFrame, q: DataFrame, event_days: DataFrame, factor: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Label samples: flow-outlier on event days, deviation when far off the model, else kept.

    The model base is p90, replaced by p50 and then the mean where missing on all sampled days of a series. Event days may carry some of the keys.
    """
    out = daily.join(q.select(*by, "date", "p90", "p50", "mean"), [*by, "date"], "left")
    counts = out.groupBy(*by).agg(F.count("p90").alias("_n90"), F.count("p50").alias("_n50"))
    if by:
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        out = out.join(counts.withColumnsRenamed({k: f"_of_{k}" for k in by}), same, "left").drop(*[f"_of_{k}" for k in by])
    else:
        row = counts.select(F.struct("_n90", "_n50")).scalar()
        out = out.withColumns({"_n90": row["_n90"], "_n50": row["_n50"]})
    base = F.when(F.col("_n90") > 0, F.col("p90")).when(F.col("_n50") > 0, F.col("p50")).otherwise(F.col("mean"))
    ratio = div(F.abs("obs"), F.abs(base))
    on = [*[k for k in by if k in event_days.columns], "date"]
    days = event_days.select(*on).distinct().withColumn("_event", F.lit(True))
    label = (F.when(F.col("_event"), "flow-outlier")
             .when((ratio >= factor) | (ratio <= 1.0 / factor), "deviation").otherwise("kept"))
    return (out.join(days, on, "left").withColumn("ratio", ratio).withColumn("label", label)
            .drop("_event", "p90", "p50", "mean", "_n90", "_n50"))
