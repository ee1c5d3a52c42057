"""Flow events: thresholds, runs of high flow, buffers, blocks and outlier days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.nulls import number
from freshet.operators.order import exact_quantiles, with_cell
from freshet.operators.resample import spine
from freshet.operators.select import threshold_fraction


def thresholds_of(df: DataFrame, value: str, specs: dict[str, float | str]) -> Column:
    """All thresholds as one struct: numbers as given, percentile tokens from a single pass."""
    tokens = {n: threshold_fraction(v) for n, v in specs.items() if isinstance(v, str)}
    if tokens:
        names = {n: f"t{i}" for i, n in enumerate(tokens)}
        row = exact_quantiles(df, [], value, {names[n]: p for n, p in tokens.items()})
        found = row.select(F.struct(*names.values())).scalar()
        return F.struct(*[(found[names[n]] if n in tokens else F.lit(float(v))).alias(n) for n, v in specs.items()])
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in specs.items()])


TIME_CELLS = 1 << 18


def _in_cells(df: DataFrame, ts: str) -> DataFrame:
    """Attach ``_us`` (time in microseconds) and ``_cell``, a slice of the time range of all records."""
    return with_cell(df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))), "_us", TIME_CELLS)


def sampling_interval_days(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Median gap between consecutive timestamps of each gauge (``keys``), in days.

    Gaps inside a time cell come from a window over that cell; the gap into a cell is taken
    from the last timestamp of the gauge's cell before it, on one summary row per gauge and cell. A gauge with any part of all
    rows is many cells. Without keys there is one gauge. Rows without a time or a key have no gap; one row alone has no interval.
    """
    keys = list(keys)
    b = df.select(*keys, ts).where(F.col(ts).isNotNull())
    for k in keys:
        b = b.where(F.col(k).isNotNull())
    b = _in_cells(b, ts)
    inside = b.select(*keys, (F.col("_us") - F.lag("_us").over(Window.partitionBy(*keys, "_cell").orderBy("_us"))).alias("_gap"))
    ends = b.groupBy(*keys, "_cell").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    between = ends.select(*keys, (F.col("_first") - F.lag("_last").over(Window.partitionBy(*keys).orderBy("_cell"))).alias("_gap"))
    gaps = inside.unionByName(between).where(F.col("_gap").isNotNull())
    us = exact_quantiles(gaps, keys, "_gap", {"us": 0.5})
    return us.select(*keys, (F.col("us") / F.lit(86400.0 * 1e6)).alias("dt_days"))


def _limits(df: DataFrame, ts: str, flow: str, thresholds: dict[str, float | str], keys: list[str]) -> DataFrame:
    """(keys, _cut, _dt): thresholds and sampling interval of each gauge."""
    tokens = {n: threshold_fraction(v) for n, v in thresholds.items() if isinstance(v, str)}
    steps = sampling_interval_days(df, ts, keys).withColumnRenamed("dt_days", "_dt")
    if not tokens:
        return steps.withColumn("_cut", F.struct(*[F.lit(float(v)).alias(n) for n, v in thresholds.items()]))
    names = {n: f"_t{i}" for i, n in enumerate(tokens)}
    found = exact_quantiles(df, keys, flow, {names[n]: p for n, p in tokens.items()})
    cut = F.struct(*[(F.col(names[n]) if n in tokens else F.lit(float(v))).alias(n) for n, v in thresholds.items()])
    return found.select(*keys, cut.alias("_cut")).join(steps, keys)


def add_event_flags(
    df: DataFrame, thresholds: dict[str, float | str], intervals: dict[str, float], ts: str = "ts", flow: str = "q",
    tiebreak: Sequence[str] = (), keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``<name>_event``: true inside runs of rows at or above a threshold that last long enough.

    ``keys`` tell gauges apart; each has its own percentile thresholds, sampling interval and runs. A run is made of
    consecutive rows of a gauge, whatever the time between them. It counts when its rows
    cover ``intervals[name]`` days at the gauge's median sampling interval. The records are cut into time
    cells: rows are ordered inside a cell of a gauge only, and one summary row per gauge and cell carries the runs
    that cross cell edges. A gauge of a single row has no interval and no event; nor have rows without a key.
    """
    missing = set(thresholds) - set(intervals)
    if missing:
        raise KeyError(f"no interval given for {sorted(missing)}")
    names, keys = list(thresholds), list(keys)
    cell = Window.partitionBy(*keys, "_cell")
    out = _in_cells(df, ts).withColumn("_rn", F.row_number().over(cell.orderBy("_us", *tiebreak)))
    if keys:
        out = out.join(_limits(df, ts, flow, thresholds, keys), keys, "left")
    else:
        out = out.withColumn("_cut", thresholds_of(df, flow, thresholds)).withColumn("_dt", sampling_interval_days(df, ts).scalar())
    above = {n: F.coalesce(F.col(flow) >= F.col("_cut")[n], F.lit(False)) for n in names}
    out = out.withColumns({f"_below_{n}": F.when(~above[n], F.col("_rn")) for n in names})
    edges = _cell_edges(out, names, keys)
    # the nearest rows below the threshold on either side, inside the cell
    out = out.withColumns({f"_before_{n}": F.max(f"_below_{n}").over(cell.orderBy("_rn")) for n in names})
    out = out.withColumns({f"_after_{n}": F.min(f"_below_{n}").over(cell.orderBy(F.col("_rn").desc())) for n in names})
    out = out.join(edges, [*keys, "_cell"], "left")
    flags = {}
    for n in names:
        length = (F.when(F.col(f"_before_{n}").isNull(), F.col(f"_head_{n}"))
                  .when(F.col(f"_after_{n}").isNull(), F.col(f"_tail_{n}"))
                  .otherwise(F.col(f"_after_{n}") - F.col(f"_before_{n}") - 1))
        long = F.col(f"_below_{n}").isNull() & (length >= F.ceil(F.lit(float(intervals[n])) / F.col("_dt")))
        flags[f"{n}_event"] = F.coalesce(long, F.lit(False)) if keys else long
    return out.withColumns(flags).select(*df.columns, *flags)


def _cell_edges(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Whole length of the run at the first and at the last row of every cell of a gauge, per threshold.

    Works on one row per gauge and cell. A cell without a row below the threshold is full and joins the
    run before it with the run after it.
    """
    s = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("n"), *[
        f(f"_below_{n}").alias(f"{side}_{n}") for n in names for f, side in ((F.min, "first"), (F.max, "last"))])
    by_cell = Window.partitionBy(*keys).orderBy("_cell")
    for n in names:
        full = F.col(f"first_{n}").isNull()
        broken, tail = F.when(full, 0).otherwise(1), F.when(~full, F.col("n") - F.col(f"last_{n}"))
        s = s.withColumn("run", F.sum(broken).over(by_cell) - broken)
        s = s.withColumn("carried", F.coalesce(F.last(tail, True).over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        s = s.withColumn(f"_head_{n}", F.col("carried") + F.sum(F.coalesce(F.col(f"first_{n}") - 1, F.col("n"))).over(Window.partitionBy(*keys, "run")))
        s = s.withColumn(f"_tail_{n}", F.coalesce(F.lead(f"_head_{n}").over(by_cell), tail))
    return s.select(*keys, "_cell", *[f"{side}_{n}" for n in names for side in ("_head", "_tail")])


def daily_events(df: DataFrame, spec: float | str, min_days: float, flow: str = "flow_m3d", keys: Sequence[str] = (),
                 date: str = "date") -> DataFrame:
    """Event flag of daily series (one row per day and series): ``is_event``."""
    keys = list(keys)
    if isinstance(spec, str):
        cuts = df.groupBy(*keys).agg(F.percentile(flow, F.lit(threshold_fraction(spec))).alias("_cut"))
        df = df.join(cuts, keys) if keys else df.withColumn("_cut", cuts.scalar())
    else:
        df = df.withColumn("_cut", F.lit(float(spec)))
    order = Window.partitionBy(*keys).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(order))
    df = df.withColumn("_gap", gap).withColumn("_above", F.coalesce(F.col(flow) >= F.col("_cut"), F.lit(False)))
    dts = df.groupBy(*keys).agg(F.percentile("_gap", F.lit(0.5)).alias("_dt"))
    df = df.join(dts, keys) if keys else df.withColumn("_dt", dts.scalar())
    run = F.row_number().over(order) - F.row_number().over(Window.partitionBy(*keys, "_above").orderBy(date))
    df = df.withColumn("_run", run)
    length = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_above", "_run"))
    need = F.ceil(F.lit(float(min_days)) / F.col("_dt"))
    return (df.withColumn("is_event", F.col("_above") & (length >= need))
            .drop("_gap", "_above", "_dt", "_run", "_cut"))


def event_days(daily: DataFrame, buffer: int = 0, view: str = "all", keys: Sequence[str] = ()) -> DataFrame:
    """Day table with is_event, is_buffered (within ``buffer`` days of an event) and is_selected."""
    keys = list(keys)
    near = (daily.where("is_event")
            .select(*keys, F.explode(F.sequence(F.date_sub("date", buffer), F.date_add("date", buffer))).alias("date"))
            .distinct().withColumn("is_buffered", F.lit(True)))
    days = (daily.select(*keys, "date", "is_event").join(near, [*keys, "date"], "left")
            .withColumn("is_buffered", F.coalesce("is_buffered", F.lit(False))))
    chosen = {"events": F.col("is_buffered"), "non_events": ~F.col("is_buffered")}.get(view, F.lit(True))
    return days.withColumn("is_selected", chosen)


def non_event_days(all_days: DataFrame, buffered: DataFrame) -> DataFrame:
    return all_days.select("date").distinct().join(buffered.select("date"), "date", "left_anti")


def excluded_blocks(days: DataFrame, keep: Column) -> DataFrame:
    """Runs of calendar days not kept, as start/finish blocks."""
    out = spine(days).join(days.where(keep).select("date"), "date", "left_anti")
    rn = F.row_number().over(Window.orderBy("date"))
    island = F.date_sub("date", rn)
    return (out.withColumn("_i", island).groupBy("_i")
            .agg(F.min("date").alias("start"), F.max("date").alias("finish"), F.count(F.lit(1)).alias("n_days")).drop("_i"))


def outlier_days(
    flow: DataFrame, method: str = "mad_log", sided: str = "upper", k: float = 3.5, iqr_k: float = 1.5,
    upper_q: float = 0.995, lower_q: float = 0.005, daily_reduce: str = "sum", value: str = "flow_m3d",
) -> DataFrame:
    """One row per day with its flow and an outlier flag."""
    v = number(F.col(value).cast("string")) if flow.schema[value].dataType.typeName() == "string" else F.col(value)
    agg = F.avg(v) if daily_reduce == "mean" else F.sum(v)
    daily = flow.groupBy(F.to_date("date").alias("date")).agg(agg.alias("q"))
    q, both = F.col("q"), sided.lower() == "both"
    method = method.lower()
    if method == "mad_log":
        logs = daily.withColumn("_x", F.log1p("q"))
        med = logs.agg(F.percentile("_x", F.lit(0.5))).scalar()
        mad = logs.agg(F.percentile(F.abs(F.col("_x") - med), F.lit(0.5))).scalar()
        z = F.try_divide(F.log1p("q") - med, 1.4826 * mad)
        flag = (F.abs(z) if both else z) > k
    elif method == "iqr":
        s = daily.agg(F.percentile("q", F.array(F.lit(0.25), F.lit(0.75)))).scalar()
        spread = s[1] - s[0]
        flag = q > s[1] + iqr_k * spread
        if both:
            flag = flag | (q < s[0] - iqr_k * spread)
    elif method == "quantile":
        s = daily.agg(F.percentile("q", F.array(F.lit(lower_q), F.lit(upper_q)))).scalar()
        flag = q > s[1]
        if both:
            flag = flag | (q < s[0])
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return daily.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))


def tag_flow_outliers(flow: DataFrame, **options) -> DataFrame:
    """Attach the outlier flag of its day to every row."""
    days = outlier_days(flow, **options).select("date", "is_outlier")
    return (flow.withColumn("_ts", F.col("date")).withColumn("date", F.to_date("date")).join(days, "date", "left")
            .withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False)))
            .drop("date").withColumnRenamed("_ts", "date"))
