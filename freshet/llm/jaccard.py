"""Similarity join of word shingles by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import lean, saved, table, words

#: Words of a shingle; Jaccard similarity of a link; samples (minhashes) of a set; samples that a set follows at each node, on average;
#: sets that are compared with each other at once; levels at most; share of pairs at the threshold to be met.
SHINGLE, SIMILAR, SAMPLES, CHILDREN, LIMIT, LEVELS, RECALL = 5, 0.8, 64, 2.5, 1024, 12, 0.999
#: A node that keeps this share of its parent's sets isn't split further. Pairs whose samples agree less often aren't compared exactly:
#: four standard deviations below the threshold.
DENSE, MAYBE = 0.7, SIMILAR - 4 * math.sqrt(SIMILAR * (1 - SIMILAR) / SAMPLES)
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _power(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(str(base), ())) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _powers[str(base)] = np.cumprod(p)
    return _powers[str(base)][:n]


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's shingles, and where each text begins. texts: words with single spaces between, not empty.

    Fewer words than a shingle are one shingle. A word's hash is its part of a running polynomial over the bytes.
    """
    b = np.frombuffer(b" ".join(texts) + b" ", np.uint8).astype(np.uint64)
    ends = np.flatnonzero(b == 32)
    starts = np.r_[0, ends[:-1] + 1]
    run = np.r_[np.uint64(0), np.cumsum((b + np.uint64(1)) * _power(_BASE, len(b)), dtype=np.uint64)]
    word = mixed((run[ends] - run[starts]) * _power(_INVERSE, len(b))[starts])
    n = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(n) - n
    whole = np.maximum(n - size + 1, 1)
    begin = np.cumsum(whole) - whole
    at = np.repeat(first - begin, whole) + np.arange(whole.sum())
    last = np.repeat(first + n, whole)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = at + k < last
        h += np.where(inside, word[np.minimum(at + k, len(word) - 1)], np.uint64(k + 1)) * np.uint64(_ODD[k % len(_ODD)])
    return mixed(h), begin


def samples(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SAMPLES minhashes of each set, as a row of 32-bit numbers."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    rng = np.random.Generator(np.random.PCG64(5))
    mul, add = (rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) for _ in range(2))
    return np.stack([np.minimum.reduceat(x * (m | np.uint32(1)) + a, begin) for m, a in zip(mul, add, strict=True)], axis=1)


def pieces(texts: list[bytes], size: int = 2_000_000) -> Iterator[list[bytes]]:
    own, total = [], 0
    for t in texts:
        if own and total + len(t) > size:
            yield own
            own, total = [], 0
        own.append(t)
        total += len(t)
    if own:
        yield own


def runs_needed(recall: float = RECALL, similar: float = SIMILAR, children: float = CHILDREN) -> int:
    """Runs after which a pair at the threshold has met with this probability, even below many levels.

    Two sets share a followed sample at a node with probability 1 - exp(-children * similar * q), q the same for the levels below.
    """
    q = 1.0
    for _ in range(LEVELS):
        q = 1 - math.exp(-children * similar * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def _numbers(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(-1, SAMPLES)


def _follow(node: np.ndarray, sig: np.ndarray, children: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and nodes of the samples that each set follows from its node: those whose hash with the node is small."""
    token = mixed(sig.astype(np.uint64) | np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))
    child = mixed(token ^ mixed(node)[:, None])
    row, col = np.nonzero(mixed(child) < np.uint64(children / SAMPLES * 2.0**64))
    return row, child[row, col].view(np.int64)


def split(sets: DataFrame, children: float = CHILDREN) -> DataFrame:
    """(node, key, above) of the children of each (node, key, sig, size), each pair once, as a set follows a sample only once."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, child = _follow(batch["node"].to_numpy().view(np.uint64), _numbers(batch["sig"]), children)
                yield pa.record_batch({"node": pa.array(child), "key": batch["key"].take(pa.array(row)), "above": batch["size"].take(pa.array(row))})

    return sets.select("node", "key", "sig", "size").mapInArrow(lean(follow), "node long, key binary, above long")


def buckets(sets: DataFrame, runs: int, children: float = CHILDREN, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """(bucket, key): at most `limit` keys a bucket. sets: (key, sig), saved.

    Every run starts with all sets at a node of its own and follows sampled tokens. Nodes of one set are dropped, nodes up to the limit are
    buckets, larger ones are split again. A large node that hardly shrank, or is at the last level, holds sets that are
    alike: it is dealt in parts of half the limit, and any two parts meet in a bucket.
    """
    roots = F.explode(F.array(*[F.lit(r + 1).cast("long") for r in range(runs)]))
    at = sets.select("key", "sig", roots.alias("node"), F.lit(2**62).alias("size"))
    found: list[DataFrame] = []
    for level in range(levels):
        below = split(at, children)
        if level:
            below = saved(below)
        size = saved(below.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"))
        known = below.join(size, "node")
        final = F.lit(level == levels - 1) | (F.col("size") > DENSE * F.col("above"))
        found.append(known.where(f"size <= {limit}").select(F.col("node").alias("bucket"), "key"))
        part = F.ceil(F.col("size") / (limit // 2)).cast("int")
        dense = known.where((F.col("size") > limit) & final).withColumn("own", F.pmod(F.xxhash64("key", F.lit(level)), part).cast("int"))
        dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0), part - 1)))
        found.append(dense.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "key"))
        if not size.where(f"size > {limit}").limit(1).count():
            break
        at = known.where((F.col("size") > limit) & ~final).select("node", "key", "size").join(sets, "key")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _by_bucket(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """work for each bucket's rows, one bucket in memory at a time."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch["bucket"].to_numpy()
            cuts = np.flatnonzero(np.diff(of)) + 1 if len(of) else []
            for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if held and a < b and held[-1]["bucket"][0].as_py() != of[a]:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return df.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(lean(go), schema)


def _met(rows: pa.Table) -> np.ndarray:
    """For each pair of a bucket's rows, whether they also meet in a bucket with a smaller number."""
    own, here = rows["buckets"].combine_chunks(), rows["bucket"][0].as_py()
    n = len(own)
    number, row = own.flatten().to_numpy(), np.repeat(np.arange(n), np.diff(own.offsets.to_numpy()))
    below = number < here
    number, row = number[below], row[below]
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    start = np.flatnonzero(np.r_[True, np.diff(number) != 0]) if len(number) else np.array([], int)
    size = np.diff(np.r_[start, len(number)])
    met = np.zeros((n, n), bool)
    for k in np.argsort(-size, kind="stable"):
        if size[k] < 2:
            break
        i = row[start[k] : start[k] + size[k]]
        met[np.ix_(i, i)] = True
        if size[k] == n:
            break
    return met


def _candidates(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's rows whose samples agree often enough and which don't meet in a bucket with a smaller number."""
    sig, open_ = _numbers(rows["sig"]), ~_met(rows)
    left, right = [], []
    for i in range(len(sig) - 1):
        j = i + 1 + np.flatnonzero(open_[i, i + 1 :])
        if len(j):
            j = j[(sig[j] == sig[i]).sum(axis=1) >= MAYBE * SAMPLES]
            left.append(np.full(len(j), i))
            right.append(j)
    return tuple(np.concatenate([*x, np.array([], int)]).astype(int) for x in (left, right))


def _live(rows: pa.Table) -> pa.Table:
    a, b = _candidates(rows)
    return rows.take(pa.array(np.unique(np.r_[a, b])))


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members sets a[i] and b[i] share: by matrix products over the members that two sets or more have."""
    if len(a) < 16:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    value, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(code, minlength=len(value)) > 1
    at = np.cumsum(often) - 1
    row, code = row[often[code]], at[code[often[code]]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    total, width = np.zeros((len(sets), len(sets)), np.float32), 2048
    for c in range(0, int(often.sum()), width):
        s, e = np.searchsorted(code, [c, c + width])
        x = np.zeros((len(sets), width), np.float32)
        x[row[s:e], code[s:e] - c] = 1
        total += x @ x.T
    return total[a, b].astype(np.int64)


def _linked(similar: float) -> Callable[[pa.Table], pa.Table]:
    def work(rows: pa.Table) -> pa.Table:
        keys = rows["key"].to_pylist()
        once = [i for i, k in enumerate(keys) if i == 0 or keys[i - 1] != k]
        rows, keys = rows.take(pa.array(once)), [keys[i] for i in once]
        a, b = _candidates(rows)
        sets = [np.frombuffer(x, np.uint64) for x in rows["members"].to_pylist()]
        both = common_counts(sets, a, b)
        n = np.array([len(s) for s in sets])
        # exact: the smallest share that isn't below the threshold, in whole numbers
        linked = both * 1_000_000 >= (n[a] + n[b] - both) * round(similar * 1_000_000)
        a, b = a[linked], b[linked]
        copies = np.array(rows["copies"].to_pylist(), np.int64)
        links = np.bincount(a, copies[b], len(keys)).astype(np.int64) + np.bincount(b, copies[a], len(keys)).astype(np.int64)
        top = np.arange(len(keys))
        while True:
            new = top.copy()
            np.minimum.at(new, a, top[b])
            np.minimum.at(new, b, top[a])
            new = new[new]
            if (new == top).all():
                break
            top = new
        got = np.flatnonzero(links)
        return pa.table({"key": rows["key"].take(pa.array(got)), "links": pa.array(links[got]), "root": rows["key"].take(pa.array(top[got]))})

    return work


def components(edges: DataFrame) -> DataFrame:
    """(key, comp): the smallest key of each connected component. edges: (key, root).

    Each round every key takes the smallest label among its neighbours and then its label's label; the labels of each round are
    written. Rounds follow the logarithm of the longest path.
    """
    pairs = edges.select("key", F.col("root").alias("to")).where("key != to").distinct()
    pairs = saved(pairs.unionByName(pairs.select(F.col("to").alias("key"), F.col("key").alias("to"))).distinct())
    labels = saved(pairs.groupBy("key").agg(F.min("to").alias("m")).select("key", F.least("key", "m").alias("comp")))
    while True:
        near = pairs.join(labels.select(F.col("key").alias("to"), "comp"), "to").groupBy("key").agg(F.min("comp").alias("m"))
        new = labels.join(near, "key", "left").select("key", F.col("comp").alias("old"), F.least("comp", F.coalesce("m", "comp")).alias("c"))
        jump = labels.select(F.col("key").alias("c"), F.col("comp").alias("further"))
        new = saved(new.join(jump, "c", "left").select("key", "old", F.least("c", F.coalesce("further", "c")).alias("comp")))
        if not new.where("old != comp").limit(1).count():
            return new.select("key", "comp")
        labels = new.select("key", "comp")


def normal(text: Column) -> Column:
    """Words in lower case with single spaces."""
    return F.array_join(words(F.lower(text)), " ")


def _each(work: Callable[[list[bytes]], list[list[bytes]]], names: list[str]) -> Callable:
    """Replace the column `norm` of batches by columns made from its texts."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                cols = work([t.encode() for t in part["norm"].to_pylist()])
                rest = {n: part[n] for n in part.schema.names if n != "norm"}
                yield pa.record_batch(rest | {n: pa.array(c, pa.binary()) for n, c in zip(names, cols, strict=True)})

    return go


def _sketch(texts: list[bytes]) -> list[list[bytes]]:
    return [[r.tobytes() for p in pieces(texts) for r in samples(*shingles(p))]]


def _members(texts: list[bytes]) -> list[list[bytes]]:
    out = []
    for p in pieces(texts):
        h, begin = shingles(p)
        out += [np.unique(s).tobytes() for s in np.split(h, begin[1:])]
    return [out]


def joined(docs: DataFrame, id: str = "doc_id", text: str = "text", similar: float = SIMILAR, recall: float = RECALL, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(documents, classes). documents: (id, key); classes: (key, first_id, n_copies, n_links, comp) of each distinct text.

    Texts are equal, and copies of each other, if their lower-case words are. n_links: other documents with a Jaccard similarity of word
    shingles of `similar` or more, copies included. comp: the key of the text's class; classes are what links connect. Texts
    without words have no key and no links. Each pair of distinct texts is verified once, in the first bucket that both are in, on their
    whole sets; buckets hand on counts and a class's edges, never pairs.
    """
    kind = docs.schema[id].dataType.simpleString()
    norm = docs.select(F.col(id).alias("id"), normal(F.col(text)).alias("norm")).where("norm != ''").withColumn("key", F.unhex(F.md5("norm")))
    documents = saved(norm.mapInArrow(lean(_each(_sketch, ["sig"])), f"id {kind}, key binary, sig binary"))
    sets = saved(documents.groupBy("key").agg(F.first("sig").alias("sig"), F.count("*").alias("copies"), F.min("id").alias("first_id")))
    meeting = buckets(sets.select("key", "sig"), runs_needed(recall, similar), limit=limit)
    where_ = saved(meeting.groupBy("key").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")))
    there = where_.join(sets.select("key", "sig", "copies", "first_id"), "key")
    rows = there.select(F.explode("buckets").alias("bucket"), "key", "sig", "buckets", "copies", "first_id")
    shape = f"bucket long, key binary, sig binary, buckets array<long>, copies long, first_id {kind}"
    live = saved(_by_bucket(rows, _live, shape))
    wanted = live.select(F.col("key").alias("k"), F.col("first_id").alias("f")).distinct()
    texts = norm.join(wanted, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("f"))).select("key", "norm")
    members = texts.mapInArrow(lean(_each(_members, ["members"])), "key binary, members binary")
    links = saved(_by_bucket(live.join(members, "key").select("bucket", "key", "sig", "buckets", "copies", "members"), _linked(similar), "key binary, links long, root binary"))
    comps = components(links)
    classes = sets.drop("sig").join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(comps, "key", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return documents.select("id", "key"), classes.select("key", "first_id", F.col("copies").alias("n_copies"), n_links.alias("n_links"), F.coalesce("comp", "key").alias("comp"))


def linked(docs: DataFrame, id: str = "doc_id", text: str = "text", similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """(id, class_id, n_links, n_copies) of every row of docs; class_id: the smallest id of the document's class.

    Texts without words are classes of their own. Ids may be null or repeated: rows are told apart by text as well.
    """
    documents, classes = joined(docs, id, text, similar, recall)
    top = saved(classes.groupBy("comp").agg(F.min("first_id").alias("class_id")))
    info = saved(classes.join(top, "comp").select("key", "class_id", "n_links", "n_copies"))
    out = documents.join(info, "key").select("id", "class_id", "n_links", "n_copies")
    empty = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("has")).where("not has")
    out = out.unionByName(empty.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))
    return out.withColumnRenamed("id", id)


def first_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each class: that of the smallest id (of equal ids, the smallest text); rows without words all stay.

    Repeated rows are copies too: one of them stays.
    """
    documents, classes = joined(docs, id, text, similar)
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id"), F.col("key"))).alias("first")
    keep = saved(classes.groupBy("comp").agg(first).select(F.struct(F.col("first.first_id").alias("id"), F.col("first.key").alias("key")).alias("_row")))
    key = F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(normal(F.col(text)))))
    rows = docs.withColumn("_key", key)
    # id and key as one value, in which nulls are equal: the join's partitioning serves the removal of repeated rows too
    some = rows.where("_key is not null").withColumn("_row", F.struct(F.col(id).alias("id"), F.col("_key").alias("key")))
    once = some.join(keep, "_row", "left_semi").dropDuplicates(["_row"])
    return once.select(*docs.columns).unionByName(rows.where("_key is null").select(*docs.columns))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(sf_dir, "documents", spark).select("doc_id", "text"))
