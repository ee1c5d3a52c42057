"""Exact quantiles and exact ranks for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task and a ranking
window sorts a whole group in one task. That is right for groups bounded by design (the
runs of one day, the days of one reach). For groups that grow with the data, such as all
lab samples or a sub-hourly gauge record, the functions here cut each group into cells of
neighbouring values first: a small histogram per group gives every cell its starting
rank, and only rows of one cell are ever sorted together. Cells come from the value
range alone, so a recomputed task always lands on the same cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16
SALTS = 4096


def bounded_quantiles(value: Column | str, probs: Sequence[float]) -> Column:
    """Linear-interpolated quantiles as an array, for groups bounded by design."""
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))


def quantile_of(values: Column | str, p: float) -> Column:
    """Linear-interpolated quantile of a sorted array."""
    pos = F.lit(float(p)) * (F.size(values) - 1)
    lo, hi = F.get(values, F.floor(pos).cast("int")), F.get(values, F.ceil(pos).cast("int"))
    return lo + (hi - lo) * (pos - F.floor(pos))


def _warp(v: Column) -> Column:
    # monotone and close to logarithmic, so a few extreme values do not swallow the cells
    return F.signum(v) * F.log1p(F.abs(v))


def with_cell(df: DataFrame, value: str, cells: int = CELLS, rows: DataFrame | None = None) -> DataFrame:
    """Attach ``_cell``: position of the value within the range of the column, low to high.

    All groups share one range, so no group has to be brought together to find its own. The
    range is read from ``rows`` when ``df`` is an aggregate of them, which needs no shuffle.
    """
    w = _warp(F.col(value).cast("double"))
    source = df if rows is None else rows
    span = source.agg(F.struct(F.min(w).alias("lo"), F.max(w).alias("hi"))).scalar()
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    share = F.coalesce(F.try_divide(w - lo, hi - lo), F.lit(0.0))
    cell = F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")
    return df.withColumn("_span", span).withColumn("_cell", cell).drop("_span")


def _cell_starts(df: DataFrame, keys: Sequence[str], weight: Column, descending: bool = False) -> DataFrame:
    """Rows of each group lying before each cell; at most one row per cell and group."""
    order = F.col("_cell").desc() if descending else F.col("_cell")
    w = Window.partitionBy(*keys).orderBy(order)
    return (
        df.groupBy(*keys, "_cell").agg(F.sum(weight).alias("_in_cell"))
        .withColumn("_start", F.sum("_in_cell").over(w) - F.col("_in_cell"))
        .withColumn("_total", F.sum("_in_cell").over(Window.partitionBy(*keys)))
    )


def exact_rank(
    df: DataFrame, keys: Sequence[str], value: str, tiebreak: Sequence[str] = (),
    descending: bool = False, cells: int = CELLS,
) -> DataFrame:
    """Attach ``rank`` (1..n by value) and ``n`` per group.

    Equal rows are counted and numbered as one row. Equal values are counted before anything is ordered and are split over
    ``SALTS`` parts by a hash of their ``tiebreak`` columns, so a value held by a third of all rows (zeros often are) is ranked
    by many tasks, whether its rows differ or not. Ties rank in the order of that hash, then of the columns.
    """
    keys = list(keys)
    tie = list(tiebreak) or [c for c in df.columns if c not in keys]
    rows = df.where(F.col(value).isNotNull()).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(SALTS)).cast("int"))
    part = [*keys, value, "_salt"]
    tally = with_cell(rows.groupBy(*part).agg(F.sum("_c").alias("_n")), value, cells, df.where(F.col(value).isNotNull()))
    starts = _cell_starts(tally, keys, F.col("_n"), descending).drop("_in_cell")
    first = F.col(value).desc() if descending else F.col(value)
    before = F.sum("_n").over(Window.partitionBy(*keys, "_cell").orderBy(first, "_salt")) - F.col("_n")
    placed = tally.withColumn("_before", before).join(starts, [*keys, "_cell"]).select(
        *part, (F.col("_start") + F.col("_before")).alias("_from"), F.col("_total").alias("n"))
    inside = Window.partitionBy(*part).orderBy(*tie, *[c for c in df.columns if c not in [*tie, *part]]).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_rn", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(placed, part)
    # equal rows take the numbers from _from + _rn + 1 on, in two steps of about the root of their count
    width = F.ceil(F.sqrt("_c")).cast("long")
    out = out.withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / width).cast("long"))))
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(width, F.col("_c") - F.col("_hi") * width))))
    rank = F.col("_from") + F.col("_rn") + F.col("_hi") * width + F.col("_k")
    return out.select(*df.columns, "n", rank.alias("rank"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], cells: int = CELLS,
) -> DataFrame:
    """One row per group with the linear-interpolated quantiles named in ``probs``."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    tally = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    celled = with_cell(tally, "_v", cells, rows)
    starts = _cell_starts(celled, keys, F.col("_n"))
    # the wanted positions: the two neighbours of p * (n - 1) for every p
    spots = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        spots.append(F.struct(F.lit(name).alias("name"), F.floor(pos).alias("at"), pos.alias("pos")))
        spots.append(F.struct(F.lit(name).alias("name"), F.ceil(pos).alias("at"), pos.alias("pos")))
    wanted = (
        starts.withColumn("_spots", F.filter(
            F.array(*spots),
            lambda s: (s["at"] >= F.col("_start")) & (s["at"] < F.col("_start") + F.col("_in_cell"))))
        .where(F.size("_spots") > 0)
        .select(*keys, "_cell", "_start", "_spots")
    )
    if not keys:
        wanted = F.broadcast(wanted)  # at most two rows per quantile
    w = Window.partitionBy(*keys, "_cell").orderBy("_v")
    picked = (
        celled.join(wanted, [*keys, "_cell"])
        .withColumn("_end", F.col("_start") + F.sum("_n").over(w))
        .withColumn("_hit", F.filter("_spots", lambda s: (s["at"] >= F.col("_end") - F.col("_n"))
                                     & (s["at"] < F.col("_end"))))
        .where(F.size("_hit") > 0)
        .select(*keys, "_v", F.explode("_hit").alias("_h"))
    )
    aggs = []
    for name in probs:
        mine = F.col("_h.name") == name
        lo = F.min(F.when(mine, F.col("_v")))
        hi = F.max(F.when(mine, F.col("_v")))
        frac = F.max(F.when(mine, F.col("_h.pos") - F.floor("_h.pos")))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return picked.groupBy(*keys).agg(*aggs)
