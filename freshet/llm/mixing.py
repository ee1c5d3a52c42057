"""Mixing sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.llm.common import n_words, saved, table, unused

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, SEED, CELLS = 1.5, 2.0, "mix-1", 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add `target` to (source, source_size): share of all sizes by weight, no more than cap times a source's size.

    Sources take the weights in turn, by code point, null last. Water-filling: a source that reaches its cap stays there and
    its excess goes to the others by weight, until none is above. Sources fill up in the order of cap by weight, so the
    level at which the rest ends is read from sums over that order. With share above cap every source ends at its cap. One row for
    each source goes to one task here; documents don't.
    """
    by_name, by_fill = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("top", cap * F.col("source_size")).withColumn("fill", F.col("top") / F.col("weight"))
    total = share * F.sum("source_size").over(W.partitionBy())
    level = (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    s = s.withColumn("level", level)
    # levels fall from the first source that stays below its cap
    reached = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(W.partitionBy())
    return s.withColumn("target", F.coalesce(F.least("top", F.col("weight") * reached), "top")).select("source", "source_size", "target")


def draw(seed: str, *cols: str) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the seed and the columns only."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, weights: tuple[float, ...] = WEIGHTS,
        share: float = SHARE, cap: float = CAP) -> DataFrame:
    """All rows and columns of docs, with size, source_size, target and copies: how often the mix takes the document.

    target / source_size is a source's number of epochs. Each document is taken its whole part of times, and once more if
    its seeded draw lies below a cut. The cut is where the sizes of the documents below it sum up to the fractional part:
    a histogram of 4096 cells over the draw finds its cell, a second one over the next digits the cell within that. Both are
    aggregated before they move, so a source with a third of all rows is 4096 rows. Null and empty texts have size 0. Rows
    with equal id and text share one draw and go together. Sources without words have target 0 and are taken 0 times.
    """
    (own,) = unused(docs, "row")
    clash = ("size", "source_size", "target", "copies")
    columns = [F.col(f"{own}.`{c}`").alias(c) for c in docs.columns if c.lower() not in clash]
    # the caller's row is one column until the end, so that its names are free
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), n_words(F.col(text)).alias("size"), draw(seed, id, text).alias("_draw"), F.col(source).alias("_source"))
    rows = rows.withColumn("_cell", F.floor(F.col("_draw") / 2**20).cast("int"))
    narrow = rows.select("_source", "_draw", "_cell", "size")
    cells = narrow.groupBy("_source", "_cell").agg(F.sum("size").alias("words"))
    sizes = cells.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size"))
    aims = targets(sizes, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # what rounding leaves of a whole number isn't a fraction
    aims = aims.withColumn("whole", F.floor(epochs + 1e-9)).withColumn("more", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))

    def cut(sums: DataFrame, cell: str, aim: str, into: list[Column]) -> DataFrame:
        """The first cell whose running sum passes the aim, and what is left to take inside it."""
        run = sums.withColumn("upto", F.sum("words").over(W.partitionBy("_source").orderBy(cell))).where(F.col("upto") > F.col(aim))
        return run.groupBy("_source").agg(F.min(F.struct(cell, "upto", "words", *into)).alias("first"))

    same = F.col("_source").eqNullSafe(F.col("source"))
    wanted = cells.join(aims, same).select("_source", "_cell", "words", "more")
    coarse = cut(wanted, "_cell", "more", [F.col("more")]).select(
        "_source", F.col("first._cell").alias("cut_cell"), (F.col("first.more") - F.col("first.upto") + F.col("first.words")).alias("left"))
    fine = narrow.withColumnRenamed("_source", "s").join(coarse, F.col("s").eqNullSafe(F.col("_source")) & (F.col("_cell") == F.col("cut_cell")))
    fine = fine.groupBy("_source", F.floor(F.col("_draw") % 2**20 / 2**8).cast("int").alias("sub"), "left").agg(F.sum("size").alias("words"))
    # the cell that the aim falls into is taken if more than half of it is wanted
    last = cut(fine, "sub", "left", [F.col("left")]).select("_source", (F.col("first.sub") + F.when(
        2 * (F.col("first.left") - F.col("first.upto") + F.col("first.words")) > F.col("first.words"), 1).otherwise(0)).alias("cut_sub"))
    c, f = coarse.withColumnRenamed("_source", "cs"), last.withColumnRenamed("_source", "fs")
    plan = aims.join(c, F.col("source").eqNullSafe(F.col("cs")), "left").join(f, F.col("source").eqNullSafe(F.col("fs")), "left")
    limit = F.coalesce(F.col("cut_cell").cast("long") * 2**20 + F.col("cut_sub").cast("long") * 2**8, F.lit(0).cast("long"))
    # written, so that its size is known and documents needn't move to meet it where it is small
    plan = saved(plan.select(F.col("source").alias("_of"), "source_size", "target", "whole", limit.alias("_limit")))
    out = rows.join(plan, F.col("_source").eqNullSafe(F.col("_of")))
    copies = (F.col("whole") + F.when(F.col("_draw") < F.col("_limit"), 1).otherwise(0)).cast("int")
    return out.select(*columns, "size", "source_size", "target", copies.alias("copies"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the mix: each document as often as `copies` says."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(unused(mixed, "copy")[0])).select(*columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = table(sf_dir, "documents", spark).select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_sql(docs: str, seed: str = SEED) -> str:
    """CTEs ending in `mixed`: the columns of docs with size, source_size, target and copies."""
    return rf"""
rows_ AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 8))::BIGINT AS draw FROM {docs}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
    2.0::DOUBLE * source_size AS top FROM sizes),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aims AS (SELECT source, source_size, coalesce(least(top, weight * (max(level) FILTER (level <= top / weight) OVER ())), top) AS target FROM levels),
parts AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-9)::INT AS whole FROM aims),
more AS (SELECT *, greatest(0, target - whole * source_size) AS more FROM parts),
cells AS (SELECT source, draw // 1048576 AS cell, sum(size) AS words FROM rows_ GROUP BY ALL),
upto AS (SELECT source, cell, words, sum(words) OVER (PARTITION BY source ORDER BY cell) AS upto FROM cells),
coarse AS (SELECT u.source, min(cell) AS cut_cell, arg_min(more - upto + words, cell) AS left_ FROM upto u JOIN more m ON u.source IS NOT DISTINCT FROM m.source WHERE upto > more GROUP BY u.source),
subs AS (SELECT r.source, left_, draw % 1048576 // 256 AS sub, sum(size) AS words FROM rows_ r JOIN coarse c ON r.source IS NOT DISTINCT FROM c.source AND draw // 1048576 = cut_cell GROUP BY ALL),
fine AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY sub) AS upto FROM subs),
last_ AS (SELECT source, min(sub) + CASE WHEN 2 * arg_min(left_ - upto + words, sub) > arg_min(words, sub) THEN 1 ELSE 0 END AS cut_sub FROM fine WHERE upto > left_ GROUP BY source),
mixed AS (SELECT r.* EXCLUDE (draw), m.source_size, m.target,
    (whole + CASE WHEN draw < coalesce(cut_cell * 1048576 + cut_sub * 256, 0) THEN 1 ELSE 0 END)::INT AS copies
  FROM rows_ r JOIN more m ON r.source IS NOT DISTINCT FROM m.source LEFT JOIN coarse c ON r.source IS NOT DISTINCT FROM c.source
  LEFT JOIN last_ l ON r.source IS NOT DISTINCT FROM l.source)"""


SQL = "WITH " + mix_sql("documents") + "\nSELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed"
