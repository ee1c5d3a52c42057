"""Comparison of two frames and of two file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.nulls import div


def _side_by_side(a: DataFrame, b: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(name, left, right) per compared cell; rows without a partner raise when the plan runs."""
    left = a.select(*keys, F.lit(True).alias("_in_a"), *[F.col(x).alias(f"_a_{x}") for x, _ in pairs])
    right = b.select(*keys, F.lit(True).alias("_in_b"), *[F.col(y).alias(f"_b_{y}") for _, y in pairs])
    both = left.join(right, list(keys), "full_outer")
    lost = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    ok = F.when(lost, F.raise_error(F.lit("the frames must have the same rows"))).otherwise(F.lit(True))
    cells = F.array(*[
        F.struct(F.lit(x if x == y else f"{x} vs {y}").alias("name"), F.col(f"_a_{x}").cast("double").alias("left"),
                 F.col(f"_b_{y}").cast("double").alias("right")) for x, y in pairs])
    return both.where(ok).select(F.explode(cells).alias("c")).select("c.*")


def differing_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], buckets: int = 1 << 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of both frames in buckets of keys whose digests differ, and (name, cells, filled, nonzero) of all other cells.

    Each side is reduced to one line for each bucket: its number of rows and the sums of two hashes of its rows. Only rows of
    buckets with different lines go on to be joined; frames that are equal are not joined at all. Missing values are hashed as such.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")

    def digest(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
        row = [F.col(k) for k in keys] + [F.coalesce(F.col(c).cast("double").cast("string"), F.lit("")) for c in columns]
        # two hashes of 31 bits each, so that the sums stay whole numbers
        sums = [F.sum(F.pmod(F.xxhash64(F.lit(i), *row), F.lit(2**31 - 1))).alias(f"_{side}{i}") for i in range(2)]
        return df.groupBy(at).agg(F.count(F.lit(1)).alias(f"_{side}n"), *sums)

    left, right = digest(a, [x for x, _ in pairs], "a"), digest(b, [y for _, y in pairs], "b")
    same = (F.col("_an") == F.col("_bn")) & (F.col("_a0") == F.col("_b0")) & (F.col("_a1") == F.col("_b1"))
    lines = left.join(right, "_bucket", "full_outer").withColumn("_same", F.coalesce(same, F.lit(False)))
    open_ = lines.where(~F.col("_same")).select("_bucket")
    rows = lambda df: df.withColumn("_bucket", at).join(open_, "_bucket", "left_semi").drop("_bucket")
    cells = F.array(*[F.struct(F.lit(x if x == y else f"{x} vs {y}").alias("name"), F.col(x).cast("double").alias("left")) for x, y in pairs])
    rest = a.withColumn("_bucket", at).join(lines.where("_same").select("_bucket"), "_bucket", "left_semi").select(F.explode(cells).alias("c")).select("c.*")
    filled = rest.groupBy("name").agg(F.count(F.lit(1)).alias("cells"), F.count("left").alias("filled"), F.count(F.when(F.col("left") != 0, 1)).alias("nonzero"))
    return rows(a), rows(b), filled


def _differs():
    return ~F.coalesce(F.col("left") == F.col("right"), F.lit(False))


def difference_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Cells that differ per column; a missing value differs from everything, also from another one.

    Only rows whose bucket has another digest on the other side are joined.
    """
    pairs = [(c, c) for c in columns]
    left, right, same = differing_rows(a, b, keys, pairs)
    found = _side_by_side(left, right, keys, pairs).groupBy("name").agg(F.count(F.when(_differs(), 1)).alias("n_different"))
    # both values of a cell in an equal bucket are missing where one is
    rest = same.select("name", (F.col("cells") - F.col("filled")).alias("n_different"))
    return found.unionByName(rest).groupBy("name").agg(F.sum("n_different").alias("n_different"))


def difference_metrics(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str],
                       renamed: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Count, mean and maximum absolute and mean relative difference of columns that differ.

    Only rows whose bucket has another digest on the other side are joined; the others have a difference of zero and enter the means by their number.
    """
    pairs = [*[(c, c) for c in columns], *renamed]
    left, right, same = differing_rows(a, b, keys, pairs)
    gap = F.abs(F.col("left") - F.col("right"))
    rel = div(gap, "left")
    found = _side_by_side(left, right, keys, pairs).groupBy("name").agg(
        F.count(F.when(_differs(), 1)).alias("n"), F.sum(gap).alias("gap"), F.count(gap).alias("n_gap"), F.max(gap).alias("top"), F.sum(rel).alias("rel"), F.count(rel).alias("n_rel"))
    zero = lambda c: F.when(F.col(c) > 0, 0.0)
    rest = same.select("name", (F.col("cells") - F.col("filled")).alias("n"), zero("filled").alias("gap"), F.col("filled").alias("n_gap"), zero("filled").alias("top"),
                       zero("nonzero").alias("rel"), F.col("nonzero").alias("n_rel"))
    out = found.unionByName(rest).groupBy("name").agg(F.sum("n").alias("n_different"), div(F.sum("gap"), F.sum("n_gap")).alias("mean_abs_diff"), F.max("top").alias("max_abs_diff"),
                                                      div(F.sum("rel"), F.sum("n_rel")).alias("mean_rel_diff"))
    return out.where(F.col("n_different") > 0)


def reconcile_files(work: DataFrame, realized: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Per realization: selected workspace files, linked, missing in and extra in the realization.

    ``work`` lists (path), ``realized`` lists (name, path). A path is selected when any pattern
    is found in it. Every realization is counted against the workspace without pairing all files.
    """
    chosen = F.lit(False)
    for p in patterns:
        chosen = chosen | F.col("path").rlike(p)
    w = work.where(chosen).select("path").distinct()
    r = realized.select("name", "path").distinct().withColumn("_sel", chosen)
    hit = r.join(w.withColumn("_in_work", F.lit(True)), "path", "left")
    linked = F.col("_in_work").isNotNull()
    total = w.agg(F.count(F.lit(1))).scalar()
    out = hit.groupBy("name").agg(
        F.count(F.when(linked, 1)).alias("linked"),
        F.count(F.when(F.col("_sel") & ~linked, 1)).alias("extra_in_realization"))
    return (out.withColumn("matched", total)
            .withColumn("missing_in_realization", F.col("matched") - F.col("linked")))
