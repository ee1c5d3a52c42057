"""Hard negatives of labelled vectors by slots between the positives' upper limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.llm.common import saved, table

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Anchors in a block, and the least and most rows in one. Rows are dealt into about ROW_BLOCKS blocks between these sizes.
ANCHORS, LEAST_ROWS, MOST_ROWS, ROW_BLOCKS = 16_384, 4_096, 131_072, 64
#: Scores that a task holds at once.
SCORES = 4_000_000


def whole(vector: Column, scale: int = 256) -> Column:
    """Each component as floor(scale * x), taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Rows with a label and a vector whose components are all finite."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(n)), n), at] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _length(lists: pa.ChunkedArray) -> int:
    return pc.max(pc.list_value_length(lists)).as_py() or 0


def products(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, exact integer scores of some rows of a with all of b).

    By Cauchy-Schwarz no sum on the way exceeds the product of the norms, so floats are exact where their digits hold that product;
    else Python's whole numbers are taken, and a score beyond 64 bits fails.
    """
    norm = [float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for m in (a, b)]
    bound = norm[0] * norm[1] * 1.01 + 1
    form = np.float32 if max(bound, *norm) < 2**24 else np.float64 if max(bound, *norm) < 2**53 else np.int64 if bound < 2**62 else object
    b = b.astype(form).T
    step = max(1, SCORES // max(1, b.shape[1]))
    for at in range(0, len(a), step):
        yield at, (a[at : at + step].astype(form) @ b).astype(np.int64)


def leading(score: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each group; of equal ones the earlier positions."""
    order = np.lexsort((-score, group))
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[nth < k]


def _block(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether they are null, labels and vectors of a block in the order of ties: by id, null last."""
    none = rows["id"].is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(rows["id"], 0).to_numpy()
    order = np.lexsort((ids, none))
    return ids[order], none[order], rows["label"].to_numpy()[order], _matrix(rows["v"], width)[order]


def _found(anchors: pa.Table, who: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"anchor": anchors["anchor"].combine_chunks().take(pa.array(who)), "slot": pa.array(slot, pa.int32()), "score": pa.array(score, pa.int64()),
                            "no_id": pa.array(none, pa.bool_()), "id": pa.array(ids, pa.int64(), mask=none)})


_FOUND = "anchor struct<id: long, label: int, hash: long>, slot int, score long, no_id boolean, id long"


def blocks(rows: DataFrame, anchors: DataFrame, run, columns: list[str]) -> DataFrame:
    """`run(anchors, rows)` for each block of anchors with each block of rows, as rows of _FOUND.

    Both sides are dealt into blocks of bounded size by a hash; a block of rows goes once to each block of anchors, and the other way
    round. The work is the product of both, as the task has it, and splits into equal independent parts of bounded memory.
    """
    n_rows, n_anchors = rows.count(), anchors.count()
    size = min(MOST_ROWS, max(LEAST_ROWS, n_rows // ROW_BLOCKS))
    parts, teams = max(1, -(-n_rows // size)), max(1, -(-n_anchors // ANCHORS))
    r = rows.select("id", "label", "v", F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("team"))
    a = anchors.select("anchor", "v", *columns, F.pmod(F.xxhash64("anchor"), F.lit(teams)).cast("int").alias("team_"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part_"))

    def both(key: tuple, own: pa.Table, other: pa.Table) -> Iterator[pa.RecordBatch]:
        if own.num_rows and other.num_rows:
            yield from run(own, other)

    def tables(key: tuple, own: pa.Table, other: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(both(key, own, other), pa.schema([
            ("anchor", pa.struct([("id", pa.int64()), ("label", pa.int32()), ("hash", pa.int64())])), ("slot", pa.int32()), ("score", pa.int64()), ("no_id", pa.bool_()), ("id", pa.int64())]))
        pa.default_memory_pool().release_unused()
        return out

    return a.groupBy("part_", "team_").cogroup(r.groupBy("part", "team")).applyInArrow(tables, _FOUND)


def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k first rows of each key by score, then id; every task cuts its own rows to k before they move."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), "no_id", "id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor, positives: array of (nth, score, id) in order): each anchor's k highest rows of its label with another id."""

    def run(own: pa.Table, other: pa.Table) -> Iterator[pa.RecordBatch]:
        width = max(_length(own["v"]), _length(other["v"]))
        ids, none, labels, v = _block(other, width)
        of = own["anchor"].combine_chunks()
        own_ids, own_labels, own_v = of.field("id").to_numpy(), of.field("label").to_numpy(), _matrix(own["v"], width)
        for label in np.unique(own_labels):
            same, at = np.flatnonzero(labels == label), np.flatnonzero(own_labels == label)
            if not len(same):
                continue
            for begin, s in products(own_v[at], v[same]):
                who = at[begin : begin + len(s)]
                ok = (ids[same][None, :] != own_ids[who][:, None]) | none[same][None, :]
                low = np.iinfo(np.int64).min
                s = np.where(ok, s, low)
                # one more than k, as the least value also stands for rows that take no part
                edge = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else np.full((len(s), 1), low)
                i, j = np.nonzero(ok & (s >= edge))
                top = leading(s[i, j], i, k)
                i, j = i[top], j[top]
                yield _found(own, who[i], s[i, j], ids[same[j]], none[same[j]], np.zeros(len(i), np.int32))

    top = best(blocks(rows, anchors, run, []), ["anchor"], k)
    return top.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "id"))).alias("positives"))


def in_slots(rows: DataFrame, anchors: DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor, slots: array of (slot, score, no_id, id)): the k first rows of another label in each slot of an anchor.

    anchors: with `limits`, the positives' scores in falling order. Slot i holds scores that the upper limits of positives 1 .. i reach
    and those after don't, so slots are disjoint and each score is looked at once for all overlapping windows. Scores above
    every upper or below every lower limit answer no window and are left out.
    """

    def run(own: pa.Table, other: pa.Table) -> Iterator[pa.RecordBatch]:
        width = max(_length(own["v"]), _length(other["v"]))
        ids, none, labels, v = _block(other, width)
        own_labels = own["anchor"].combine_chunks().field("label").to_numpy()
        limits = own["limits"].to_pylist()
        # windows of negative positives are empty
        most = np.array([max(x) * high // 100 if x and max(x) >= 0 else -1 for x in limits], np.int64)
        least = np.array([min((-(-y * low // 100) for y in x if y >= 0), default=0) for x in limits], np.int64)
        widest = max(map(len, limits))
        tops = np.full((len(limits), widest), np.iinfo(np.int64).min)
        for i, x in enumerate(limits):
            tops[i, : len(x)] = [y * high // 100 for y in x]
        for begin, s in products(_matrix(own["v"], width), v):
            who = np.arange(begin, begin + len(s))
            i, j = np.nonzero((s <= most[who][:, None]) & (s >= least[who][:, None]) & (labels[None, :] != own_labels[who][:, None]))
            score = s[i, j]
            slot = (score[:, None] <= tops[who[i]]).sum(axis=1) if len(i) < 100_000 else sum((score <= tops[who[i], c]).astype(np.int64) for c in range(widest))
            top = leading(score, i * (widest + 1) + slot, k)
            yield _found(own, who[i[top]], score[top], ids[j[top]], none[j[top]], slot[top])

    kept = best(blocks(rows, anchors, run, ["limits"]), ["anchor", "slot"], k)
    return kept.groupBy("anchor").agg(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "no_id", "id")).alias("slots"))


def mined(df: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
          low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where is_anchor holds; repeated rows are one anchor, and rows of one id that differ are several. A score is the integer
    inner product; shorter vectors are filled up with zeros. Rows go by falling score, then id, null ids last. An anchor's positives are the
    first rows of its label with another id, each row for itself, repeated or not; its negatives are rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Rows without label, vector or with a component that is null or
    not finite take no part; null ids are never anchors. An empty table and anchors without a positive or negative give no rows.

    First all positives are found, then each row is put into one slot of an anchor; the answers of all windows come from
    merging slots from the lowest limit upwards. What moves is the vectors, in blocks, and k rows for each anchor, slot and block.
    """
    rows = saved(usable(df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks")), "vector", "label")
                 .select("id", "label", whole(F.col("vector")).alias("v"), "asks"))
    key = F.struct("id", "label", F.xxhash64("v").alias("hash")).alias("anchor")
    anchors = saved(rows.where("asks and id is not null").select(key, "v").groupBy("anchor").agg(F.first("v").alias("v")))
    found = saved(positives(rows, anchors, n_positives))
    limits = anchors.join(found, "anchor").select("anchor", "v", F.transform("positives", lambda p: p.score).alias("limits"))
    slots = in_slots(rows, limits, n_negatives, low, high)

    # from the last positive to the first: the best of its slot and of all slots below
    merge = f"""aggregate(sequence(size(positives), 1, -1), struct(cast(array() as array<struct<down: long, no_id: boolean, id: long>>) as top,
            cast(array() as array<struct<at: int, top: array<struct<down: long, no_id: boolean, id: long>>>>) as done),
        (s, i) -> transform(array(slice(array_sort(concat(s.top, transform(filter(slots, x -> x.slot = i), x -> struct(x.down, x.no_id, x.id)))), 1, {n_negatives})),
            t -> struct(t as top, concat(s.done, array(struct(i as at, t as top))) as done))[0], s -> s.done)"""
    out = found.join(slots, "anchor").select("anchor", F.col("positives").alias("p"), F.explode(F.expr(merge)).alias("w"))
    p = F.element_at("p", F.col("w.at"))
    fits = F.filter("w.top", lambda t: (-t.down * 100 >= low * p.score) & (-t.down * 100 <= high * p.score))
    out = out.select(F.col("anchor.id").alias("anchor_id"), p.id.alias("positive_id"), p.score.alias("positive_score"), F.posexplode(fits).alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.down")).alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector against all; every seventh vector's label is moved on by one first."""
    rows = table(sf_dir, "embeddings", spark)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows, F.col("vec_id") % 50 == 0)


SQL = """
WITH r AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT k, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM r),
a AS (SELECT row_number() OVER () AS n, * FROM (SELECT DISTINCT vec_id, label, q FROM v WHERE vec_id % 50 = 0)),
c AS (SELECT k, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS x FROM v),
ac AS (SELECT n, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS x FROM a),
dot AS (SELECT n, k, sum(ac.x * c.x)::BIGINT AS score FROM ac JOIN c USING (i) GROUP BY n, k),
s AS (SELECT a.n, a.vec_id AS anchor_id, v.k, v.vec_id, a.label = v.label AS same, coalesce(score, 0) AS score
      FROM a JOIN v ON TRUE LEFT JOIN dot ON dot.n = a.n AND dot.k = v.k WHERE NOT (a.label = v.label AND a.vec_id IS NOT DISTINCT FROM v.vec_id)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) <= 5),
w AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.n, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST)::INT AS rank
      FROM p JOIN s ON s.n = p.n AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3"""
