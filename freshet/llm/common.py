"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of what separates words.
GAP = r"[\x20\x09-\x0D]+"


def saved(df: DataFrame) -> DataFrame:
    """The frame written once as Parquet below spark.checkpoint.dir and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    if not (top := spark.conf.get("spark.checkpoint.dir", "")):
        alone = spark.conf.get("spark.master", "local").startswith("local") and "cluster" not in spark.conf.get("spark.master", "local")
        # one machine may use a folder of its own; a cluster without the setting has its warehouse in common
        top = tempfile.mkdtemp(prefix="spark-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name with underscores before it until no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := "_" + name).lower() in taken:
            pass
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building them: each starts after a gap."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def table(sf_dir: str, name: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 400, most: int = 4_000_000) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts in slices of at most so many rows, and of few bytes beyond `most`."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, rows):
            part = texts.slice(at, rows).to_pylist()
            begin = size = 0
            for k, t in enumerate(part):
                size += len(t or "")
                if size > most or k == len(part) - 1:
                    yield ids.slice(at + begin, k + 1 - begin), part[begin : k + 1]
                    begin, size = k + 1, 0


def squeezed(items: list[bytes]) -> bytes:
    """Many short byte strings as one compressed value; `opened` gives the list back."""
    lengths = np.fromiter(map(len, items), np.uint32, len(items))
    return zstandard.compress(len(items).to_bytes(4, "little") + lengths.tobytes() + b"".join(items), 3)


def joint(value: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths of the byte strings of `squeezed`, and all of them joined."""
    raw = zstandard.decompress(value)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, np.uint32, n, 4), raw[4 + 4 * n :]


def each_of(value: bytes, some: int = 10_000) -> Iterator[bytes]:
    """The byte strings of `squeezed` one after another."""
    lengths, raw = joint(value)
    begin = 0
    for at in range(0, len(lengths), some):
        ends = (np.cumsum(lengths[at : at + some], dtype=np.int64) + begin).tolist()
        yield from (raw[a:b] for a, b in zip([begin, *ends], ends, strict=False))
        begin = ends[-1]


def opened(value: bytes) -> list[bytes]:
    raw = zstandard.decompress(value)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def give_back() -> None:
    """Memory that Arrow and C's allocator hold but don't use goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task of `mapInArrow` that gives memory back when its rows are out, and what the worker's last task left before it begins.

    Workers live on from task to task, and would hold the most of one task beside what the next one needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from task(batches)
        give_back()

    return run


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; empty for null."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]
