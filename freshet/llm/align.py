"""Alignment of two tokenizers: the tokens between common ends of both form a group, and all tokens of a group are linked."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.llm.common import saved, slices, table

#: Ends that one piece of a merge takes.
PIECE = 1 << 16
#: Text bytes in a block, which asks for each of its id pairs once.
BLOCK_BYTES = 16_000_000
#: How a byte-level vocabulary shows bytes as characters.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def byte_level(path: str):
    """A byte-level BPE file as an encoder of many texts and the bytes of each id. Strings of special tokens are ordinary text.

    The vocabulary and its split pattern are handed to tiktoken, which gives the same ids several times faster (tests compare both).
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    shown = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(SHOWN))}
    t = Tokenizer.from_file(path)
    own = {bytes(shown[c] for c in piece): i for piece, i in t.get_vocab(with_added_tokens=False).items() if all(c in shown for c in piece)}
    special = t.get_added_tokens_decoder()
    own = {b: i for b, i in own.items() if i not in special}
    encoding = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    pieces = [b""] * (max(own.values(), default=-1) + 1)
    for b, i in own.items():
        pieces[i] = b
    return encoding.encode_ordinary, pieces


@lru_cache(maxsize=2)
def piece_level(path: str):
    """A sentencepiece file as an encoder of many texts and the bytes of each id; U+2581 is a space and <0xHH> a byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    return lambda texts: sp.encode(texts, num_threads=1), pieces


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and in b of the ends that both have. Both increase strictly.

    Merge path: the merged order of both is cut on diagonals into pieces of equal work. A binary search on each diagonal, all at once,
    finds how many ends of a lie before the cut. Pieces are merged by themselves; an equal pair that a cut would part stays before it.
    """
    work = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, work - len(b)), np.minimum(work, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # a[mid] stands before the cut if it isn't above the last end of b that would
        before = open_.copy()
        before[open_] = a[mid[open_]] <= b[work[open_] - mid[open_] - 1]
        low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
    i, j = low, work - low
    whole = (i > 0) & (j < len(b))
    whole[whole] = a[i[whole] - 1] == b[j[whole]]
    j = j + whole
    found = []
    for k in range(len(work) - 1):
        own = a[i[k] : i[k + 1]]
        at = np.searchsorted(b[j[k] : j[k + 1]], own) + j[k]
        same = at < j[k + 1]
        same[same] = b[at[same]] == own[same]
        found.append((np.flatnonzero(same) + i[k], at[same]))
    return tuple(np.concatenate(x) if x else np.array([], np.int64) for x in (list(zip(*found, strict=True)) or [[], []]))


class Aligned:
    """A batch of texts: token ids of both tokenizers, one after another, and the groups they form.

    a, b: ids; n_a, n_b: tokens of each text; ga, gb: tokens of each group; n_groups: groups of each text; a_of, b_of: group of each token.
    """

    def __init__(self, texts: list[str | None], a_path: str, b_path: str, piece: int = PIECE) -> None:
        (a_encode, a_pieces), (b_encode, b_pieces) = byte_level(a_path), piece_level(b_path)
        a_ids, b_ids = [[]] * len(texts), [[]] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        for i, b in zip(some, b_encode([texts[i] for i in some]), strict=True):
            whole = " " + texts[i]
            a = a_encode(whole)
            whole = whole.encode()
            if b"".join(map(a_pieces.__getitem__, a)) == whole == b"".join(map(b_pieces.__getitem__, b)):
                a_ids[i], b_ids[i] = a, b
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids))
        self.a, self.b = (np.fromiter((i for x in ids for i in x), np.int64, n.sum()) for ids, n in ((a_ids, self.n_a), (b_ids, self.n_b)))
        # texts follow one another, and both tokenizers end where a text ends
        a_ends, b_ends = (np.cumsum(_lengths(path, of)[ids]) for path, of, ids in ((a_path, byte_level, self.a), (b_path, piece_level, self.b)))
        at_a, at_b = common_ends(a_ends, b_ends, piece)
        self.ga, self.gb = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        groups = np.arange(len(at_a))
        self.a_of, self.b_of = np.repeat(groups, self.ga), np.repeat(groups, self.gb)
        upto = np.searchsorted(at_a, np.cumsum(self.n_a) - 1, "right")
        self.n_groups = np.diff(upto, prepend=0)
        self.n_links = _sums(self.ga * self.gb, self.n_groups)

    def digests(self, a_size: int, b_size: int) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2` of each text; empty without tokens."""
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        before_b, through_a = np.cumsum(self.gb) - self.gb, np.cumsum(self.ga)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + before_b[self.a_of]] = 2 * self.a + last(self.a_of)
        code[np.arange(len(self.b)) + through_a[self.b_of]] = 2 * a_size + 2 * self.b + last(self.b_of)
        shown, ends = _shown(a_size, b_size), np.cumsum(self.n_a + self.n_b).tolist()
        return [hashlib.sha256(b"".join(map(shown.__getitem__, code[s:e].tolist()))[:-1]).hexdigest() if s < e else "" for s, e in zip([0, *ends], ends, strict=False)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, times, number of pairs of each text): the distinct linked id pairs of each text as a << 16 | b, in order.

        Groups of many links are taken by their distinct ids first, so the work follows the pairs and not the links.
        """
        text_of, links = np.repeat(np.arange(len(self.n_groups)), self.n_groups), self.ga * self.gb
        a0, b0 = np.cumsum(self.ga) - self.ga, np.cumsum(self.gb) - self.gb
        small = links <= 64
        each = np.where(small, self.gb, 0)[self.a_of]
        a_at = np.repeat(np.arange(len(self.a)), each)
        nth = np.arange(len(a_at)) - np.repeat(np.cumsum(each) - each, each)
        of = self.a_of[a_at]
        keys, times = [text_of[of] << 32 | self.a[a_at] << 16 | self.b[b0[of] + nth]], [np.ones(len(a_at), np.int64)]
        for g in np.flatnonzero(~small):
            (x, nx), (y, ny) = (np.unique(ids[s : s + n], return_counts=True) for ids, s, n in ((self.a, a0[g], self.ga[g]), (self.b, b0[g], self.gb[g])))
            keys.append((text_of[g] << 32 | x[:, None] << 16 | y[None, :]).ravel())
            times.append((nx[:, None] * ny[None, :]).ravel())
        key, n = np.concatenate(keys), np.concatenate(times)
        if (n == 1).all():
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.add.reduceat(n, first) if len(first) else n
        key = key[first]
        return key & 0xFFFFFFFF, n, np.bincount(key >> 32, minlength=len(self.n_groups))


@lru_cache(maxsize=4)
def _lengths(path: str, of) -> np.ndarray:
    return np.array([len(p) for p in of(path)[1]], np.int64)


@lru_cache(maxsize=2)
def _shown(a_size: int, b_size: int) -> list[bytes]:
    """Each id with what follows it: inside and at the end of a group's ids of the first tokenizer, then of the second."""
    return [b"%d%s" % (i, c) for n, ends in ((a_size, (b",", b"|")), (b_size, (b",", b";"))) for i in range(n) for c in ends]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of so many values each."""
    upto = np.append(0, np.cumsum(values))[np.append(0, np.cumsum(counts))]
    return np.diff(upto)


def aligned(docs: DataFrame, id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, a_ids, b_ids, a_counts, b_counts): token ids of both tokenizers, and how many of each every group takes, in order.

    The first tokenizer (byte-level) encodes a space and the text, the second adds the space itself; neither adds special tokens.
    Offsets are bytes. Null and empty texts, and those of which one tokenizer changes bytes, have empty lists. One row for
    each row of docs, repeated ones too; other columns are left out. A text is one task's work, cut into pieces of equal work.
    """
    a_path, b_path = a_path or _path("byte_bpe_50k.json"), b_path or _path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            x = Aligned(texts, a_path, b_path)
            lists = {n: pa.ListArray.from_arrays(np.append(0, np.cumsum(k)).astype(np.int32), pa.array(v.astype(np.int32)))
                     for n, v, k in (("a_ids", x.a, x.n_a), ("b_ids", x.b, x.n_b), ("a_counts", x.ga, x.n_groups), ("b_counts", x.gb, x.n_groups))}
            yield pa.record_batch({id: ids, **lists})

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias(id), F.col(text).alias("text")).mapInArrow(run, f"`{id}` {kind}, a_ids array<int>, b_ids array<int>, a_counts array<int>, b_counts array<int>")


def linked(docs: DataFrame, id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two frames: (block, id, n_a, n_b, n_groups, n_links, groups_sha256, links) of each row of docs, and the links' table (block, pairs, docs).

    A block is some 16 MB of text that follow each other in one task. It numbers its distinct id pairs; `links` is the compressed list of
    the numbers and times of a document's pairs, and `docs` says how many documents of the block hold each pair. Written once.
    """
    a_path, b_path = a_path or _path("byte_bpe_50k.json"), b_path or _path("piece_bpe_32k.model")
    kind = docs.schema[id].dataType.simpleString()
    fields = f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, docs array<long>"

    def block_rows(block: int, parts: list[dict]) -> Iterator[pa.RecordBatch]:
        pair, docs_ = np.unique(np.concatenate([p["pair"] for p in parts]), return_counts=True)
        blank = {c: pa.nulls(1, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
        yield pa.record_batch({"block": pa.array([block]), "id": pa.nulls(1, parts[0]["id"].type), **blank, "groups_sha256": pa.nulls(1, pa.string()), "links": pa.nulls(1, pa.binary()),
                               "pairs": pa.array([pair], pa.list_(pa.int64())), "docs": pa.array([docs_], pa.list_(pa.int64()))})
        for p in parts:
            at, ends = np.searchsorted(pair, p["pair"]), np.cumsum(p["per"])
            links = [zstandard.compress(np.concatenate([np.diff(at[s:e], prepend=0), p["times"][s:e]]).astype(np.uint32).tobytes(), 1) for s, e in zip([0, *ends], ends, strict=False)]
            n = len(links)
            yield pa.record_batch({"block": pa.array(np.full(n, block)), "id": p["id"], **{c: pa.array(p[c]) for c in blank}, "groups_sha256": pa.array(p["sha"]),
                                   "links": pa.array(links, pa.binary()), "pairs": pa.nulls(n, pa.list_(pa.int64())), "docs": pa.nulls(n, pa.list_(pa.int64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [len(of(path)[1]) for of, path in ((byte_level, a_path), (piece_level, b_path))]
        parts, held, block = [], 0, TaskContext.get().partitionId() << 32
        for ids, texts in slices(batches):
            x = Aligned(texts, a_path, b_path)
            pair, times, per = x.pairs()
            parts.append({"id": ids, "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "n_links": x.n_links, "sha": x.digests(*sizes),
                          "pair": pair.astype(np.int64), "times": times, "per": per})
            held += sum(len(t or "") for t in texts)
            if held > BLOCK_BYTES:
                yield from block_rows(block, parts)
                parts, held, block = [], 0, block + 1
        if parts:
            yield from block_rows(block, parts)
        pa.default_memory_pool().release_unused()

    out = saved(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, fields))
    return out.where("pairs is null").drop("pairs", "docs"), out.where("pairs is not null").select("block", "pairs", "docs")


def pair_counts(tables: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents of all blocks each id pair is linked, and whether its first id has no pair in more.

    All pairs of one id meet in one window: at most as many as the other vocabulary has ids.
    """
    each = tables.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))
    of_a = W.partitionBy(F.shiftright("pair", 16))
    return each.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs.

    A link's count is in how many documents (rows) of the whole corpus its id pair is linked; count_sum adds it up over the links,
    n_best counts links whose count is the highest of their first id, ties included. Texts without tokens, as `aligned` has it: zeros and ''.
    A block asks once for each of its pairs, and the answers meet the block's documents, which carry no text any more.
    """
    rows, tables = linked(docs, id, text, a_path, b_path)
    asked = tables.select(F.col("block").alias("asked_by"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(pair_counts(tables), "pair").select("asked_by", "at", "n", "best")
    kind = docs.schema[id].dataType.simpleString()

    def total(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        n, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        at = found["at"].to_numpy()
        n[at], best[at] = found["n"].to_numpy(), found["best"].to_numpy()
        sums, bests = [], []
        for raw in own["links"].to_pylist():
            gaps, times = np.frombuffer(zstandard.decompress(raw), np.uint32).astype(np.int64).reshape(2, -1)
            pairs = np.cumsum(gaps)
            sums.append(int(times @ n[pairs]))
            bests.append(int(times @ best[pairs]))
        return own.drop_columns(["block", "links"]).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    out = rows.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(
        total, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.select(F.col("id").alias(id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the counts and digest of the aligned tokens of every document."""
    return measured(table(sf_dir, "documents", spark))
