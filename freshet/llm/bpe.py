"""BPE encoding and decoding by a table of distinct words."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import each_of, give_back, joint, lean, opened, slices, squeezed, table

#: Text in a block, which asks for each of its distinct words once, and the parts that words are dealt into by hash.
BLOCK_BYTES, BUCKETS = 16_000_000, 8192

#: How the vocabulary splits text before merging, and how it shows bytes as characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=2)
def _splitter(path: str) -> tuple[regex.Pattern, regex.Pattern | None]:
    special = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return regex.compile(PATTERN), regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


def split(text: str, path: str) -> list[str]:
    """The words of a text in order; special tokens are words of their own. All of them joined are the text."""
    words, special = _splitter(path)
    if special is None or not special.search(text):
        return words.findall(text)
    return [w for i, part in enumerate(special.split(text)) for w in ([part] if i % 2 else words.findall(part))]


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """The bytes of each id."""
    t = _tokenizer(path)
    shown = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(SHOWN))}
    special = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
    out = [special[i] if i in special else bytes(shown[c] for c in t.id_to_token(i) or "") for i in range(t.get_vocab_size(with_added_tokens=True))]
    return pa.array(out, pa.binary())


def width(path: str) -> np.dtype:
    """The smallest number type that holds the vocabulary's ids."""
    return np.dtype(np.uint16 if _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.int32)


def texts_of(ids: pa.Array, path: str) -> pa.Array:
    """The text of each list of ids: ids are joined with the vocabulary's pieces, and the pieces of a list with each other."""
    flat = pieces(path).take(ids.flatten())
    counts = np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)]), flat), b"")
    try:
        out = joined.cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
    return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.string()))


def _small(numbers: np.ndarray) -> bytes:
    """Numbers, frequent ones low, as compressed bytes: one byte below 240, else three; four where three don't reach."""
    n = len(numbers).to_bytes(4, "little")
    if len(numbers) and numbers.max() >= 16 << 16:
        return b"\1" + n + zstandard.compress(numbers.astype(np.uint32).tobytes(), 1)
    more = numbers >= 240
    first = np.where(more, 240 + (numbers >> 16), numbers).astype(np.uint8)
    return b"\0" + n + zstandard.compress(first.tobytes() + (numbers[more] & 0xFFFF).astype(np.uint16).tobytes(), 1)


def _numbers(value: bytes) -> np.ndarray:
    n, raw = int.from_bytes(value[1:5], "little"), zstandard.decompress(value[5:])
    if value[0]:
        return np.frombuffer(raw, np.uint32).astype(np.int64)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    more = out >= 240
    out[more] = (out[more] - 240 << 16) + np.frombuffer(raw, np.uint16, offset=n)
    return out


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, back: bool = False) -> DataFrame:
    """(id, ids): the token ids of each text, one row for each row of docs; none for null and empty texts. back: also `decoded`,
    the text of these ids.

    Texts are split once, in blocks of some 16 MB that follow each other in one task. A block numbers its distinct words, and from then on a
    document is the numbers of its words; one shuffle of them by block serves both what follows. The blocks' words meet in buckets by hash, where
    each distinct word of the corpus is encoded once; a task reads the blocks' rows of a bucket one after another and holds its distinct words only. The
    ids go back to the blocks that asked and are joined by position. A frequent word is one entry for each block, so it is no hot key, and no
    text moves. Long texts are whole rows. Other columns are left out.
    """
    path = path or vocabulary()
    kind = docs.schema[id].dataType.simpleString()

    def block_rows(block: int, parts: list[tuple[pa.Array, list[np.ndarray]]], at: dict[str, int]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(at), np.int64)
        for _, own in parts:
            count += np.bincount(np.concatenate(own), minlength=len(at))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        words = [w.encode() for w in at]
        at.clear()
        yield pa.record_batch({"block": pa.array([block]), "id": pa.nulls(1, parts[0][0].type), "numbers": pa.nulls(1, pa.binary()), "words": pa.array([squeezed([words[i] for i in order])], pa.binary())})
        del words, count, order
        for ids, own in parts:
            yield pa.record_batch({"block": pa.array(np.full(len(own), block)), "id": ids, "numbers": pa.array([_small(rank[x]) for x in own], pa.binary()), "words": pa.nulls(len(own), pa.binary())})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at, held, block = [], {}, 0, TaskContext.get().partitionId() << 32
        for ids, texts in slices(batches):
            own = []
            for t in texts:
                words = split(t, path) if t else []
                for w in set(words):
                    at.setdefault(w, len(at))
                own.append(np.fromiter(map(at.__getitem__, words), np.uint32, len(words)))
                held += len(t or "")
            parts.append((ids, own))
            if held > BLOCK_BYTES:
                yield from block_rows(block, parts, at)
                parts, at, held, block = [], {}, 0, block + 1
        if parts:
            yield from block_rows(block, parts, at)

    def bucket_of(words: Iterable[bytes]) -> np.ndarray:
        return np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int32)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch["block"].to_pylist(), batch["words"].to_pylist(), strict=True):
                own = opened(words) if words is not None else []
                if not own:
                    continue
                of = bucket_of(own)
                order = np.argsort(of, kind="stable")
                first = np.flatnonzero(np.diff(of[order], prepend=-1))
                packs = [squeezed([own[i] for i in part]) for part in np.split(order, first[1:])]
                yield pa.record_batch({"bucket": pa.array(of[order][first]), "block": pa.array(np.full(len(packs), block)), "words": pa.array(packs, pa.binary())})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, form = _tokenizer(path), width(path)
        known: dict[bytes, bytes] = {}  # words of the bucket that the last rows belong to
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            lists, buckets = [opened(w) for w in batch["words"].to_pylist()], batch["bucket"].to_numpy()
            fresh = list({w for own in lists for w in own if w not in known})
            for i in range(0, len(fresh), 5000):
                some = fresh[i : i + 5000]
                for w, e in zip(some, t.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, form).tobytes()
            yield pa.record_batch({"asked_by": batch["block"], "bucket": batch["bucket"], "ids": pa.array([squeezed([known[w] for w in own]) for own in lists], pa.binary())})
            known = {w: x for w, x in known.items() if zlib.crc32(w) % BUCKETS == buckets[-1]} if len(buckets) else known

    # what becomes of a row is settled in the tasks, so that both sides read the same shuffle
    blocks = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(lean(number), f"block long, id {kind}, numbers binary, words binary").repartition("block")
    asked = blocks.mapInArrow(lean(ask), "bucket int, block long, words binary")
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(encoded), "asked_by long, bucket int, ids binary")

    def joined(texts: pa.Table, found: pa.Table) -> Iterator[pa.RecordBatch]:
        form = width(path)
        # answers lie by bucket, and in a bucket by the number of the word
        order = np.argsort(bucket_of(w for x in texts["words"].drop_null().to_pylist() for w in each_of(x)), kind="stable")
        packs = [joint(x) for x in found.sort_by("bucket")["ids"].to_pylist()] if found.num_rows else []
        size = np.concatenate([*(x for x, _ in packs), np.array([], np.uint32)]).astype(np.int64) // form.itemsize
        n, start, flat = np.empty(len(size), np.int64), np.empty(len(size), np.int64), np.frombuffer(b"".join(x for _, x in packs), form)
        n[order], start[order] = size, np.cumsum(size) - size
        del packs, order, size
        for batch in texts.filter(pc.is_valid(texts["numbers"])).to_batches(200):
            docs_ = [_numbers(p) for p in batch["numbers"].to_pylist()]
            word = np.concatenate([*docs_, np.array([], np.int64)])
            upto = np.cumsum(n[word]) if len(word) else word
            ids = flat[np.repeat(start[word] - upto + n[word], n[word]) + np.arange(upto[-1] if len(upto) else 0)]
            ends = np.cumsum([len(d) for d in docs_])
            offsets = np.r_[0, np.r_[0, upto][ends]].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.record_batch({"id": batch["id"], "ids": lists} | ({"decoded": texts_of(lists, path)} if back else {}))

    def join(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        give_back()  # of the block before
        out = pa.Table.from_batches(joined(texts, found), pa.schema([("id", texts.schema.field("id").type), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())][: 3 if back else 2]))
        give_back()
        return out

    found = blocks.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(join, f"id {kind}, ids array<int>" + ", decoded string" * back)
    return found.withColumnRenamed("id", id)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, to: str = "decoded") -> DataFrame:
    """All columns and `to`, the text of the ids: each id is joined with its piece, the vocabulary's own table of fixed size.

    Bytes that aren't UTF-8 become the replacement character. Unknown ids fail; null ids are null.
    """
    path = path or vocabulary()

    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return texts_of(x.cast(pa.list_(pa.int32())), path)

    return encoded.withColumn(to, text(F.col(ids)))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = encode(table(sf_dir, "documents", spark), back=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
