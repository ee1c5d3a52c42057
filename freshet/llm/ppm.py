"""Scoring by partial matching: a byte-context trie learned from the corpus."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import opened, saved, slices, squeezed, table

#: Bytes of context. Orders up to LOW have at most 256^(LOW + 1) entries for any corpus and are sent to every task; entries of higher
#: orders lie in the bucket of the last LOW + 1 bytes of their context, which all their longer contexts share.
ORDER, LOW = 6, 2
END = b"\n"
#: Bytes of texts in a block, and grams that are counted at once.
BLOCK, AT_ONCE = 32_000_000, 3_000_000
LOG = np.log10(np.e)


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lowered, then one end."""
    return [*text.lower().split(), END]


def held_out(id: object) -> bool:
    return zlib.crc32(("" if id is None else str(id)).encode()) % 7 == 2


def positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their contexts (last byte lowest), bytes of context there are, and each symbol's word.

    A word is followed by a space, its own last symbol, unless it ends in the end; contexts start with the space before the word. A text is
    read as one long word, its own words joined by spaces, so that contexts run across them.
    """
    parts = [b" " + w + (b"" if w.endswith(END) else b" ") for w in words]
    s = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    of = np.repeat(np.arange(len(parts)), n)
    at = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
    context = np.zeros(len(s), np.int64)
    for k in range(1, ORDER + 1):
        context[k:] |= s[:-k] << (8 * (k - 1))
    short = np.flatnonzero(at < ORDER)
    context[short] &= (1 << 8 * at[short]) - 1
    own = at > 0
    return s[own], context[own], np.minimum(at[own], ORDER), of[own]


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with its context as one number, bytes of context << 56 | context << 8 | symbol, and its word."""
    symbol, context, known, of = positions(words)
    return known << 56 | context << 8 | symbol, of


def summed_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys)
    key = keys[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
    return key[first], np.add.reduceat(counts[order], first).astype(np.int64) if len(key) else first


def rolled(gram: np.ndarray, counts: np.ndarray, orders: range = range(ORDER + 1)) -> tuple[np.ndarray, np.ndarray]:
    """Trie entries of these orders, order << 56 | context << 8 | symbol, with their counts."""
    made = []
    for k in orders:
        own = gram >> 56 >= k
        made.append(summed_up(gram[own] & ((1 << 8 * (k + 1)) - 1) | k << 56, counts[own]))
    return np.concatenate([x for x, _ in made]), np.concatenate([n for _, n in made])


def entries(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All trie entries of words with counts."""
    gram, of = grams(words)
    return rolled(gram, counts[of])


def turned(gram: np.ndarray) -> np.ndarray:
    """Grams with the bytes of their contexts in the opposite order, so that those of like contexts lie together; twice gives them back."""
    context = (gram >> 8 & ((1 << 8 * ORDER) - 1)).astype("<i8").byteswap().view("<u8") >> np.uint64(64 - 8 * ORDER)
    return gram >> 56 << 56 | context.astype(np.int64) << 8 | gram & 255


def pressed(x: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, compressed; `unpressed` gives them back."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def unpressed(value: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(value), np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Trie:
    """Contexts and symbols as sorted arrays, with what escapes need.

    A symbol seen c times after the longest known context has probability (c - 1/2) / T, T the context's count. The rest
    escapes to the context one byte shorter: half a count for each distinct symbol, and the counts of symbols that are too rare to be
    kept. There the symbols already ruled out are excluded from counts. Below the empty context, the symbols left of 256 are
    equally likely. Shorter contexts of kept ones are kept, with all their symbols.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, node: np.ndarray, total: np.ndarray) -> None:
        """Entries as of `entries`; of the contexts, key >> 8, all counts, kept or not."""
        order, by_node = np.argsort(key), np.argsort(node)
        key, count, node, total = key[order], count[order].astype(np.float64), node[by_node], total[by_node].astype(np.float64)
        self.entry, self.count, self.node, self.total, self.lost, self.distinct, self.shorter = [], [], [], [], [], [], []
        for k in range(ORDER + 1):
            own = key >> 56 == k
            e, c = key[own] & ((1 << 56) - 1), count[own]
            at, start, n = np.unique(e >> 8, return_index=True, return_counts=True)
            full = total[np.searchsorted(node, at | k << 48)] if len(e) else c
            above = np.zeros(len(e))
            if k and len(e):
                above = self.count[k - 1][np.searchsorted(self.entry[k - 1], (e >> 8 & ((1 << 8 * (k - 1)) - 1)) << 8 | e & 255)]
            sums = (lambda x: np.add.reduceat(x, start)) if len(e) else (lambda x: x)
            for to, x in ((self.entry, e), (self.count, c), (self.node, at), (self.total, full), (self.lost, full - sums(c)), (self.distinct, n.astype(np.float64)), (self.shorter, sums(above))):
                to.append(x)

    @classmethod
    def whole(cls, key: np.ndarray, count: np.ndarray) -> Trie:
        """Of entries none of which is left out."""
        return cls(key, count, *summed_up(key >> 8, count))

    def grams(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol."""
        parts = [gram[i : i + 500_000] for i in range(0, len(gram), 500_000)]
        return np.concatenate([np.zeros(0)] + [self.symbols(x & 255, x >> 8 & ((1 << 8 * ORDER) - 1), x >> 56) for x in parts])

    def symbols(self, symbol: np.ndarray, context: np.ndarray, known: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context."""
        p = np.zeros(len(symbol))
        left = np.arange(len(symbol))
        gone_total, gone_distinct = np.zeros(len(symbol)), np.zeros(len(symbol))
        for k in range(ORDER, -1, -1):
            if not len(self.node[k]):
                continue
            c = context[left] & ((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(self.node[k], c), len(self.node[k]) - 1)
            here = (self.node[k][at] == c) & (known[left] >= k)
            i, c, at = left[here], c[here], at[here]
            e = c << 8 | symbol[i]
            to = np.minimum(np.searchsorted(self.entry[k], e), len(self.entry[k]) - 1)
            seen = self.entry[k][to] == e
            total, distinct = self.total[k][at] - gone_total[i], self.distinct[k][at] - gone_distinct[i]
            escape = self.lost[k][at] + distinct / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                p[i] += np.where(seen, np.log10((self.count[k][to] - 0.5) / total), np.where(escape > 0, np.log10(escape / total), 0.0))
            gone_total[i], gone_distinct[i] = self.shorter[k][at], self.distinct[k][at]
            done = np.zeros(len(symbol), bool)
            done[i[seen]] = True
            left = left[~done[left]]
        p[left] -= np.log10(256 - gone_distinct[left])
        return p


def adaptive(words: np.ndarray, p: np.ndarray) -> float:
    """log10 probability of a document whose own words so far are a level above the trie.

    words: the document's words as numbers; p: their log10 probability by the trie where they stand. After n words, d of them distinct, a
    word seen c times has probability (c - 1/2) / n, and each word, seen or not, has d / 2n of the trie's besides. As that needs no
    probability of other words in the same place, it is a distribution for any contexts.
    """
    return float(adaptives(words, p, np.array([len(words)]))[0])


def adaptives(words: np.ndarray, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """`adaptive` of documents one after another; sizes: their numbers of words, none 0."""
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words))
    n = (at - first[of]).astype(np.float64)
    key = of << 32 | words
    order = np.argsort(key, kind="stable")
    new_run = np.r_[True, np.diff(key[order]) != 0]
    before = np.empty(len(words))
    before[order] = at - np.maximum.accumulate(np.where(new_run, at, 0))
    fresh = before == 0
    distinct = np.cumsum(fresh) - fresh
    distinct -= distinct[first][of]
    with np.errstate(divide="ignore", invalid="ignore"):
        by_trie = np.where(n > 0, np.log(distinct / 2 / n), 0.0) + p / LOG
        own = np.where(fresh, -np.inf, np.log((before - 0.5) / n))
        return np.add.reduceat(np.logaddexp(by_trie, own) * LOG, first)


def running(text: str | None) -> bytes:
    """A text's tokens joined by spaces."""
    return b" ".join(tokens((text or "").encode()))


def words_of(runs: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Tokens of running texts, each but an end with its space; where in the joined texts each begins; how many each text has."""
    joined = b"".join(runs)
    s = np.frombuffer(joined, np.uint8)
    offsets = np.r_[0, np.flatnonzero((s == 32) | (s == END[0])) + 1]
    sizes = np.diff(np.searchsorted(offsets, np.cumsum([0, *map(len, runs)])))
    all_ = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined)])
    return all_.dictionary_encode(), offsets[:-1], sizes


class Block:
    """Running texts of some rows with their distinct words and grams, and how often training rows hold these."""

    def __init__(self) -> None:
        self.size = self.waiting = 0
        self.packs: list[bytes] = []
        self.words: list[tuple[pa.Array, np.ndarray]] = []
        self.raw: list[np.ndarray] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        runs = [running(t) for t in texts]
        train = np.array([not held_out(i) for i in ids.to_pylist()], np.int64)
        part = pa.table({"id": ids, "run": pa.array(runs, pa.binary())})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
            w.write_table(part)
        self.packs.append(out.getvalue().to_pybytes())
        words, _, sizes = words_of(runs)
        self.words.append((words.dictionary, np.bincount(words.indices.to_numpy(), np.repeat(train, sizes), len(words.dictionary))))
        gram, of = grams(runs)
        self.raw.append(gram << 1 | train[of])
        self.size += sum(map(len, runs))
        self.waiting += len(gram)
        if self.waiting > AT_ONCE:
            self.reduce()

    def reduce(self) -> None:
        marked = np.concatenate(self.raw)
        self.raw, self.waiting = [], 0
        marked.sort()
        train = (marked & 1).astype(np.int32)
        marked >>= 1
        first = np.flatnonzero(np.r_[True, marked[1:] != marked[:-1]])
        self.found.append((marked[first], np.add.reduceat(train, first)))
        if sum(len(x) for x, _ in self.words[1:]) > 300_000:
            self.words = [self.all_words()]

    def all_words(self) -> tuple[pa.Array, np.ndarray]:
        both = pa.concat_arrays([x for x, _ in self.words]).dictionary_encode()
        return both.dictionary, np.bincount(both.indices.to_numpy(), np.concatenate([n for _, n in self.words])).astype(np.int64)

    def all_grams(self) -> tuple[np.ndarray, np.ndarray]:
        """In ranges of grams, to hold little beside them."""
        longest = max((x for x, _ in self.found), key=len)
        edges = longest[:: len(longest) // 16 + 1][1:]
        cuts = [[0, *np.searchsorted(x, edges), len(x)] for x, _ in self.found]
        parts = [summed_up(*(np.concatenate([x[i][c[k] : c[k + 1]] for x, c in zip(self.found, cuts, strict=True)]) for i in (0, 1))) for k in range(len(edges) + 1)]
        self.found = []
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """The texts, and the words and grams in buckets."""

        def made(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            kinds = {"bucket": pa.int32(), "words": pa.binary(), "keys": pa.binary(), "counts": pa.binary(), "pack": pa.binary()}
            return pa.record_batch({"block": pa.array([block] * n, pa.int64())} | {c: columns[c].cast(k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()})

        def dealt(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The order by bucket, and where in it each begins."""
            order = np.argsort(bucket, kind="stable")
            return order, np.flatnonzero(np.diff(bucket[order], prepend=-1))

        for p in self.packs:
            yield made(pack=pa.array([p], pa.binary()))
        self.packs = []
        if self.raw:
            self.reduce()
        distinct, count = self.all_words()
        self.words, own = [], distinct.to_pylist()
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in own), np.int64, len(own))
        order, starts = dealt(bucket)
        parts = [sorted(x.tolist(), key=own.__getitem__) for x in np.split(order, starts[1:])]
        yield made(bucket=pa.array(bucket[order[starts]]), words=pa.array([squeezed([own[i] for i in x]) for x in parts]), counts=pa.array([pressed(count[x]) for x in parts]))
        del distinct, own, parts
        key, n = self.all_grams()
        order = np.argsort(turned(key))
        key, n = key[order], n[order]
        bucket = ((key >> 8 & ((1 << 8 * (LOW + 1)) - 1)) * 0x9E3779B1 >> 12) % buckets
        order, starts = dealt(bucket)
        keys, counts = np.split(turned(key[order]), starts[1:]), np.split(n[order], starts[1:])
        yield made(bucket=pa.array(bucket[order[starts]]), keys=pa.array([pressed(x) for x in keys]), counts=pa.array([pressed(x) for x in counts]))


def asked(docs: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, words, keys, counts, pack): rows of docs, an id and a text, in blocks of one task each.

    A block has its texts in packs, and its distinct words and grams with their training counts, each in one row of one bucket: words by their
    hash, grams (as of `turned`) by the end of the context. All rows of a bucket hold all that a word, or orders above LOW, need. Blocks
    follow how the rows lie in tasks, so the frame is to be written before it is read twice.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        for ids, texts in slices(batches, most=500_000):
            block.add(ids, texts)
            if block.size > BLOCK:
                yield from block.rows(number, buckets)
                number, block = number + 1, Block()
        if block.packs:
            yield from block.rows(number, buckets)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(ask, "block long, bucket int, words binary, keys binary, counts binary, pack binary")


def summed(rows: pa.Table) -> tuple[list[list[bytes]], dict[bytes, int]]:
    """The words of each row of a bucket, and all of them with their counts."""
    lists, total = [opened(w) for w in rows["words"].to_pylist()], {}
    for words, counts in zip(lists, rows["counts"].to_pylist(), strict=True):
        for w, n in zip(words, unpressed(counts).tolist(), strict=True):
            total[w] = total.get(w, 0) + n
    return lists, total


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, pretrained, adaptive) of every row of docs.

    Words and grams (a byte and its context) of each block of documents are counted once and meet in buckets by hash. A bucket of grams
    has all training counts of its contexts, whatever their number, and none is left out; it scores each distinct gram once. The answers return to
    the blocks, where each document's bytes and words are added up. A text's probability is that of its words and end, contexts reaching back
    over words to the space before the text: `pretrained` by the trie alone, `adaptive` with the document's own words above it, `score` by a
    model that is either with equal chance. Null texts are empty: an end alone. A null id is learned from. Without training rows all bytes are
    equally likely. Repeated rows are learned from as often as they occur.
    """
    spark, kind = docs.sparkSession, docs.schema[id].dataType.simpleString()
    questions = saved(asked(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked_words, asked_grams = (questions.where(F.col(c).isNotNull()).select("bucket", "block", c, "counts") for c in ("words", "keys"))

    def counts_of(rows: pa.Table) -> pa.Table:
        n = [x for x in summed(rows)[1].values() if x]
        return pa.table({"n": pa.array([sum(n)], pa.int64()), "v": pa.array([len(n)], pa.int64())})

    first = asked_words.select("bucket", "words", "counts").groupBy("bucket").applyInArrow(counts_of, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n_all, n_distinct = (x or 0 for x in first)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"], strict=True):
                key, n = turned(unpressed(keys.as_py())), unpressed(counts.as_py())
                key, n = key[n > 0], n[n > 0]
                found.append(summed_up(np.minimum(key >> 56, LOW) << 56 | key & ((1 << 8 * (LOW + 1)) - 1), n))
                size += len(found[-1][0])
                if size > AT_ONCE // 4:
                    found = [summed_up(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                    size = 0
        key, n = summed_up(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2
        yield pa.record_batch({"key": pa.array(key), "n": pa.array(n)})

    low = asked_grams.select("keys", "counts").mapInArrow(lowest, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    shared = spark.sparkContext.broadcast(rolled(low["key"].to_numpy(), low["n"].to_numpy(), range(LOW + 1)))

    def scored_grams(rows: pa.Table) -> pa.Table:
        keys = [turned(unpressed(x)) for x in rows["keys"].to_pylist()]
        counts = np.concatenate([unpressed(x) for x in rows["counts"].to_pylist()])
        gram, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, counts, len(gram)).astype(np.int64)
        high = rolled(gram[n > 0], n[n > 0], range(LOW + 1, ORDER + 1))
        p = Trie.whole(*(np.concatenate(x) for x in zip(shared.value, high, strict=True))).grams(gram)
        parts = np.split(p[at], np.cumsum([len(x) for x in keys])[:-1])
        return pa.table({"block": rows["block"], "keys": rows["keys"], "values": pa.array([zstandard.compress(x.tobytes(), 1) for x in parts], pa.binary())})

    def scored(rows: pa.Table) -> pa.Table:
        lists, total = summed(rows)
        values = [pressed(np.fromiter((total[w] for w in x), np.int64, len(x))) for x in lists]
        return pa.table({"block": rows["block"], "words": rows["words"], "values": pa.array(values, pa.binary())})

    answers = asked_words.groupBy("bucket").applyInArrow(scored, "block long, words binary, values binary")
    answers = answers.unionByName(asked_grams.groupBy("bucket").applyInArrow(scored_grams, "block long, keys binary, values binary"), allowMissingColumns=True)

    def added(texts: pa.Table, found: pa.Table) -> Iterator[pa.RecordBatch]:
        count: dict[bytes, int] = {}
        keys, chances = [], []
        for w, g, v in zip(found["words"].to_pylist(), found["keys"].to_pylist(), found["values"].to_pylist(), strict=True):
            if w is None:
                keys.append(turned(unpressed(g))), chances.append(np.frombuffer(zstandard.decompress(v)))
            else:
                count.update(zip(opened(w), unpressed(v).tolist(), strict=True))
        key, chance = pd.Index(np.concatenate(keys)), np.concatenate(chances)
        for batch in (b for p in texts["pack"] for b in pa.ipc.open_stream(p.as_buffer())):
            runs = batch["run"].to_pylist()
            words, starts, sizes = words_of(runs)
            own, n = words.indices.to_numpy(), np.fromiter((count[w] for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            p = np.add.reduceat(chance[key.get_indexer(grams(runs)[0])], starts)
            docs = np.cumsum(sizes) - sizes
            plain, adapted = np.add.reduceat(p, docs), adaptives(own, p, sizes)
            yield pa.record_batch({
                "id": batch["id"], "held_out": pa.array([held_out(i) for i in batch["id"].to_pylist()], pa.bool_()), "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((n > 0).astype(np.int64)[own], docs)), "train_tokens": pa.array(np.full(len(runs), n_all, np.int64)),
                "base_score": pa.array(np.add.reduceat(np.log10((n + 1) / (n_all + n_distinct + 1))[own], docs)),
                "score": pa.array(np.logaddexp(plain / LOG, adapted / LOG) * LOG + np.log10(0.5)), "pretrained": pa.array(plain), "adaptive": pa.array(adapted)})

    def add(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(added(texts, found)))

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, pretrained double, adaptive double"
    packs = questions.where("pack is not null").select("block", "pack")
    return packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, schema).withColumnRenamed("id", id)


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(sf_dir, "documents", spark))
