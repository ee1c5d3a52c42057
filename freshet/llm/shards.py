"""Sharding by best-fit-decreasing packing of indivisible groups."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.llm.common import saved, table

#: Rows in a cell in which one task numbers documents or groups.
CELL = 16_384
#: Sizes above 2^12 are rounded up to so many significant bits while they are packed.
BITS = 12
#: What a document takes in a shard beside its text.
FRAME_BYTES = 16


class Room:
    """A balanced search tree (a treap) of the open shards by remaining room, then number."""

    def __init__(self) -> None:
        self.root, self.rng = None, random.Random(0)

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[3], rest = self._split(t[3], key)
            return t, rest
        less, t[2] = self._split(t[2], key)
        return less, t

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, room: int, shard: int) -> None:
        less, more = self._split(self.root, (room, shard))
        self.root = self._join(self._join(less, [(room, shard), self.rng.random(), None, None]), more)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, shard) that holds the size."""
        at, found = self.root, None
        while at is not None:
            at, found = (at[2], at[0]) if at[0][0] >= size else (at[3], found)
        if found is not None:
            less, rest = self._split(self.root, found)
            _, more = self._split(rest, (found[0], found[1] + 1))
            self.root = self._join(less, more)
        return found


def best_fit(classes: list[tuple[int, int]], capacity: int, first: int = 0, limit: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """Pack (size, number of groups), largest first: [(size, shard, number)] and the shard after the last.

    Equal sizes enter one shard until it is too tight, which is what packing them one by one does. A size above the capacity has
    a shard of its own. None if more than `limit` shards are needed.
    """
    room, out, n = Room(), [], first
    for size, left in sorted(classes, reverse=True):
        while left:
            at = room.take(size)
            if at is None:
                if limit is not None and n - first >= limit:
                    return None
                at, n = (max(size, capacity), n), n + 1
            k = min(left, at[0] // size)
            out.append((size, at[1], k))
            room.add(at[0] - k * size, at[1])
            left -= k
    return out, n


def even_fit(classes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int]]:
    """Pack into n_shards of nearly the same size: best fit with the least capacity, in steps, that needs no more shards.

    Groups above an even share of what is left have a shard of their own first. At twice the even share best fit always ends,
    since all shards but one are then more than half full.
    """
    left, alone = [list(c) for c in sorted(classes, reverse=True)], []
    total, n = sum(s * m for s, m in classes), n_shards
    while left and n > 1 and left[0][0] * n > total:
        alone.append((left[0][0], len(alone), 1))
        total, n = total - left[0][0], n - 1
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    over = 1e-5
    while (fit := best_fit([tuple(c) for c in left], -int(-total * (1 + over) // n), len(alone), n)) is None:
        over *= 2
    return alone + fit[0]


def rounded(size: Column) -> Column:
    """The size rounded up to BITS significant bits, so that there are at most about 100,000 sizes in any corpus."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(size)) - (BITS - 1)).cast("int")
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return (F.ceil(size / step) * step).cast("long")


def numbered(df: DataFrame, within: list[str], order: list[str], to: str, weight: Column | None = None) -> DataFrame:
    """Add `to`: a number from 0 without gaps among the rows with equal `within`, in an order by a hash of `order` and by `order`.

    weight: each row takes so many numbers, and `to` is its first. Rows are dealt into cells of about CELL rows, as many as the
    rows of their key need, by the hash; sums over cells tell where each cell begins. A key with any part of all rows is so many cells.
    """
    w = F.lit(1) if weight is None else weight
    many = df.groupBy(*within).agg(F.ceil(F.count("*") / CELL).cast("long").alias("_cells"))
    dealt = df.join(many, within).withColumn("_cell", F.pmod(F.xxhash64(*order), F.col("_cells")))
    sums = dealt.groupBy(*within, "_cell").agg(F.sum(w).alias("_n"))
    begins = sums.withColumn("_begin", F.sum("_n").over(W.partitionBy(*within).orderBy("_cell")) - F.col("_n")).drop("_n")
    inside = F.sum(w).over(W.partitionBy(*within, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - w
    return dealt.join(begins, [*within, "_cell"]).withColumn(to, F.col("_begin") + inside).drop("_cell", "_cells", "_begin")


def sharded(docs: DataFrame, id: str = "doc_id", text: str = "text", n_shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(id, size, text_crc32, text_md5, shard, slot): one row for each row of docs; the shard holds all rows with an equal text.

    n_shards: shards 0 .. n_shards - 1 of nearly equal bytes; or capacity: as few shards of at most so many bytes as best fit finds.
    A size is the UTF-8 bytes of the text and FRAME_BYTES. Null texts are empty texts; texts are told apart by MD5. A group above the capacity or above an
    even share has a shard of its own. Slots count from 0 without gaps in each shard. Repeated rows get a slot each. Fewer groups
    than shards leave shards empty; no rows give none. Other columns are left out; `texts` brings the text back.

    Rows are counted by (text, id), then by text, before they move further. The driver sees the number of groups of each rounded
    size: at most about 100,000 rows at any size of the input; it returns how many of each size enter each shard.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give n_shards or capacity")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), (F.octet_length(t) + FRAME_BYTES).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.unhex(F.md5(t.cast("binary"))).alias("h"))
    rows = saved(rows.groupBy("id", "h").agg(F.first("size").alias("size"), F.first("crc").alias("crc"), F.count("*").alias("n")))
    groups = rows.groupBy("h").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")).select("h", rounded(F.col("bytes")).alias("bytes"))
    groups = saved(groups)
    classes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()]
    pieces = even_fit(classes, n_shards) if n_shards is not None else best_fit(classes, capacity)[0]
    upto: dict[int, list[tuple[int, int]]] = {}
    for size, shard, k in pieces:
        of = upto.setdefault(size, [])
        of.append(((of[-1][0] if of else 0) + k, shard))
    plan = docs.sparkSession.createDataFrame(list(upto.items()), "bytes long, pieces array<struct<upto: long, shard: int>>")
    placed = numbered(groups, ["bytes"], ["h"], "rank").join(plan, "bytes")
    placed = placed.select("h", F.filter("pieces", lambda p: p.upto > F.col("rank"))[0].shard.alias("shard"))
    out = numbered(saved(rows.join(placed, "h")), ["shard"], ["h", "id"], "first", F.col("n"))
    return out.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.col("h").alias("text_md5"), "shard",
                      F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))


def write_shards(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", files: int = 8, **limits: int) -> None:
    """Write (id, text, slot) of `sharded` as Parquet below shard=N, each shard as up to `files` files in the order of slots.

    Each distinct text meets the rows that hold it once. Null texts are written as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    of = docs.select(F.unhex(F.md5(t.cast("binary"))).alias("text_md5"), t.alias(text)).dropDuplicates(["text_md5"])
    out = saved(sharded(docs, id, text, **limits)).join(of, "text_md5").select(id, text, "slot", "shard")
    ends = out.groupBy("shard").agg(F.max("slot").alias("_last"))
    out = out.join(ends, "shard").withColumn("_file", F.floor(F.col("slot") * files / (F.col("_last") + 1)).cast("int"))
    out = out.repartition("shard", "_file").sortWithinPartitions("shard", "_file", "slot").drop("_last", "_file")
    out.write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document in 40 shards of nearly equal bytes."""
    out = sharded(table(sf_dir, "documents", spark), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
