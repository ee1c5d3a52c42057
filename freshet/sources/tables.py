"""Attribute tables, samples, ledgers, fingerprints and the parsed-run dataset."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.nulls import number
from freshet.operators.ledger import parse_lines



def whole_id(c: Column) -> Column:
    """Integer id out of text such as 123,0."""
    return F.split_part(c.cast("string"), F.lit(","), F.lit(1)).try_cast("int")


def clean_attributes(raw: DataFrame, id_col: str, required: Sequence[str] = (), decimal_comma_last_n: int = 0) -> DataFrame:
    """Text attribute table with an integer id and decimal commas of the last n columns resolved."""
    lost = [c for c in [id_col, *required] if c not in raw.columns]
    if lost:
        raise KeyError(f"missing columns {lost}")
    comma = set(raw.columns[len(raw.columns) - decimal_comma_last_n:]) if decimal_comma_last_n else set()
    return raw.select(*[
        whole_id(F.col(c)).alias(c) if c == id_col else (number(c, True).alias(c) if c in comma else F.col(c)) for c in raw.columns])


def read_attributes(spark: SparkSession, path: str, id_col: str, required: Sequence[str] = (), sep: str = ";",
                    decimal_comma_last_n: int = 3) -> DataFrame:
    """HRU attribute CSV."""
    return clean_attributes(spark.read.csv(path, sep=sep, header=True), id_col, required, decimal_comma_last_n)


def read_population(spark: SparkSession, path: str, id_col: str = "GRIDCODE", sep: str = ";", decimal_comma_last_n: int = 0) -> DataFrame:
    """Population CSV by sub-basin."""
    return read_attributes(spark, path, id_col, (), sep, decimal_comma_last_n)


def read_samples(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Lab samples as (station, analyte, date, value); the value stays text."""
    return spark.read.csv(path, sep=sep, header=True).select(
        F.col("est_estaci").alias("station"), F.col("NOMBRE").alias("analyte"),
        F.col("F_MUESTREO").try_cast("timestamp_ntz").alias("date"), F.col("RESULTADO").alias("value"))


def read_flow(spark: SparkSession, path: str, value: str, date: str = "date", sep: str = ",") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True).select(
        F.col(date).try_cast("timestamp_ntz").alias("date"), number(value).alias("flow_m3d"))


def read_ledger(spark: SparkSession, path: str, typed_args: bool = False) -> DataFrame:
    return parse_lines(spark.read.text(path), typed_args=typed_args)


def fingerprints(spark: SparkSession, path: str | Sequence[str], with_hash: bool = True, kind: str | None = None) -> DataFrame:
    """Path, size, modification time and SHA-256 of input files.

    Files of any size are hashed inside the executors, one path per row, in chunks of 1 MiB.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.format("binaryFile").load(paths)
    meta = df.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    label = F.lit(kind).cast("string").alias("kind")
    if not with_hash:
        return meta.select("*", F.lit(None).cast("string").alias("sha256"), label)
    return meta.mapInArrow(_hashed, "path string, size long, mtime double, sha256 string").select("*", label)


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a listing (path, size, mtime) that are new, or differ in size or time from a manifest of fingerprints."""
    old = manifest.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("sha256").alias("_sha"))
    same = (listing["path"] == old["path"]) & (listing["size"] == F.col("_size")) & (listing["mtime"] == F.col("_mtime")) & F.col("_sha").isNotNull()
    return listing.join(old, same, "left_anti")


def fingerprints_since(spark: SparkSession, path: str | Sequence[str], manifest: DataFrame, kind: str | None = None) -> DataFrame:
    """Fingerprints of all files there are now, as ``fingerprints`` gives them; files that stand unchanged in the manifest are not read again.

    Files that are gone are left out, and so are their lines of the manifest. Of repeated lines for a file any one counts.
    """
    now = fingerprints(spark, path, with_hash=False, kind=kind)
    fresh = changed_files(now, manifest)
    known = manifest.where("sha256 is not null").select("path", "size", "mtime", "sha256").dropDuplicates(["path", "size", "mtime"])
    kept = now.drop("sha256").join(known, ["path", "size", "mtime"])
    hashed = fresh.select("path", "size", "mtime").mapInArrow(_hashed, "path string, size long, mtime double, sha256 string")
    columns = ["path", "size", "mtime", "sha256"]
    return hashed.select(*columns).unionByName(kept.select(*columns)).withColumn("kind", F.lit(kind).cast("string"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for uri in batch["path"].to_pylist():
            store, inside = pa_fs.FileSystem.from_uri(uri)
            digest = hashlib.sha256()
            with store.open_input_stream(inside) as f:
                while chunk := f.read(1 << 20):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.record_batch({**{c: batch[c] for c in batch.schema.names}, "sha256": pa.array(found, pa.string())})


def upstream_files(spark: SparkSession, folder: str, pattern: str, others: Sequence[str] = ()) -> DataFrame:
    """Paths of the inputs of a job: the files of a folder matching a pattern, and single named files."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    if others:
        listed = listed.unionByName(spark.createDataFrame([(o,) for o in others], "path string"))
    return listed.distinct()


def write_runs(df: DataFrame, path: str, mode: str = "overwrite", only_these: bool = False) -> None:
    """Parsed runs as parquet by ``run_no``; a large run is split over several files.

    ``only_these``: the runs of df replace those stored under the same number, and all others stay as they are.
    """
    out = df.hint("rebalance", "run_no").write.mode(mode).partitionBy("run_no")
    (out.option("partitionOverwriteMode", "dynamic") if only_these else out).parquet(path)


def read_runs(spark: SparkSession, path: str, runs: Sequence[int] | DataFrame | None = None, later_wins: bool = True) -> DataFrame:
    """Selected runs from the parsed dataset; of rows with the same name and day the later run counts.

    ``runs``: numbers, or a frame with a column run_no; either way only the folders of these runs are read.
    """
    df = spark.read.parquet(path)
    if isinstance(runs, DataFrame):
        # the wanted numbers prune folders while the query runs
        df = df.join(runs.select(F.col("run_no").cast("int").alias("run_no")).where("run_no is not null").distinct(), "run_no").select(*df.columns)
    elif runs is not None:
        df = df.where(F.col("run_no").isin([int(r) for r in runs]))
    return latest_runs(df) if later_wins else df


def latest_runs(df: DataFrame, name: str = "run_id", keys: Sequence[str] = ("run_id", "rch", "date"), order: str = "run_no") -> DataFrame:
    """The rows of the latest run for each key, where only names stored under several numbers are shuffled.

    Names and numbers are read first, two columns of which the number is a folder; rows of a name with one number pass as they are.
    """
    several = df.groupBy(name).agg((F.min(order) != F.max(order)).alias("_twice")).where("_twice")
    twice = several.select(F.col(name).alias("_name"))
    once = df.join(twice, F.col(name).eqNullSafe(F.col("_name")), "left_anti")
    return once.unionByName(latest_rows(df.join(twice, F.col(name).eqNullSafe(F.col("_name")), "left_semi"), keys, order))


def latest_rows(df: DataFrame, keys: Sequence[str] = ("run_id", "rch", "date"), order: str = "run_no") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*df.columns))


def run_number(name: Column) -> Column:
    """Run number out of a folder name such as run000155_real000526."""
    return F.regexp_extract(name, r"run(\d+)_", 1).try_cast("int")
