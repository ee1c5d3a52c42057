"""Toxicity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import table

#: Labelled documents that the model is fitted on, at most; features of the model; grades above 0; where rejection starts.
SAMPLE, FEATURES, GRADES, REJECT = 12_000, 4096, 3, 0.4
HASH = 1 << 20
#: A word counts as often as it is distinct evidence: grades of the labelled come from this share of telling words.
MIN_DOCS = 8


def features(text: str | None, buckets: int = HASH) -> dict[int, int]:
    """Hashes of a text's distinct words, lower case and without punctuation at the ends, with their counts."""
    out: dict[int, int] = {}
    for w in (text or "").lower().split():
        w = w.strip(".,;:!?\"'()[]{}<>|*#$%&~-_")
        if w:
            h = _hash(w, buckets)
            out[h] = out.get(h, 0) + 1
    return out


def _hash(word: str, buckets: int) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "replace")) % buckets


class Ordinal:
    """P(grade <= k) = 1 / (1 + exp(w.x - t_k)), t ascending: one weight for each feature, shared by all thresholds."""

    def __init__(self, weight: dict[int, float], thresholds: np.ndarray) -> None:
        self.weight, self.thresholds = weight, thresholds

    def raw(self, found: dict[int, int]) -> float:
        get = self.weight.get
        return float(sum(w * np.log1p(n) for h, n in found.items() if (w := get(h)) is not None))

    def grades(self, raw: np.ndarray) -> np.ndarray:
        """Rows of P(grade = 0), ..., P(grade = K)."""
        upto = 1 / (1 + np.exp(np.clip(raw[:, None] - self.thresholds, -50, 50)))
        return np.diff(np.c_[np.zeros(len(raw)), upto, np.ones(len(raw))], axis=1)


def severity(amount: np.ndarray, toxic: np.ndarray, n_grades: int = GRADES) -> np.ndarray:
    """Grades of labelled documents: 0 for label 0; toxic ones 1 to n_grades by their amount of telling words, in equal parts."""
    out = np.zeros(len(toxic), int)
    if toxic.any():
        cuts = np.quantile(amount[toxic == 1], [k / n_grades for k in range(1, n_grades)])
        out[toxic == 1] = 1 + np.searchsorted(cuts, amount[toxic == 1], side="right")
    return out


def fit(row: np.ndarray, word: np.ndarray, times: np.ndarray, toxic: np.ndarray, n_features: int = FEATURES, n_grades: int = GRADES, steps: int = 300) -> Ordinal:
    """Maximum likelihood of grades with an L2 penalty, by full gradient steps with momentum.

    row, word, times: sparse word counts. Features are the words whose presence tells most about the label, among those in MIN_DOCS
    documents or more. The telling words that grade toxic documents are those at least ten times as frequent among them. Without both
    labels every document gets grade 0.
    """
    n, n1 = len(toxic), int(toxic.sum())
    if not n1 or n1 == n:
        return Ordinal({}, np.full(n_grades, 50.0))
    docs = np.bincount(word, minlength=HASH)
    pos = np.bincount(word[toxic[row] == 1], minlength=HASH)
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((docs - pos + 0.5) / (n - n1 + 1))
    gain = np.where(docs >= MIN_DOCS, np.abs(odds) * docs * np.abs(pos / np.maximum(docs, 1) - n1 / n), 0)
    columns = np.sort(np.argsort(-gain, kind="stable")[: min(n_features, int((gain > 0).sum()))])
    telling = (docs >= MIN_DOCS) & (odds > np.log(10))
    grade = severity(np.bincount(row, times * telling[word], n), toxic, n_grades)
    at = np.full(HASH, -1, np.int32)
    at[columns] = np.arange(len(columns))
    own = at[word] >= 0
    r, c, v = row[own], at[word[own]], np.log1p(times[own])
    w, t = np.zeros(len(columns)), np.linspace(1.0, 2.0, n_grades)
    vw, vt = np.zeros_like(w), np.zeros_like(t)
    penalty, rate = 1e-4, 2.0
    for _ in range(steps):
        raw = np.bincount(r, w[c] * v, n)
        upper = np.where(grade < n_grades, t[np.minimum(grade, n_grades - 1)], 50.0)
        lower = np.where(grade > 0, t[np.maximum(grade - 1, 0)], -50.0)
        a, b = 1 / (1 + np.exp(np.clip(raw - upper, -50, 50))), 1 / (1 + np.exp(np.clip(raw - lower, -50, 50)))
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        gw = np.bincount(c, (da - db)[r] * v, len(columns)) / n + penalty * w
        gt = np.array([(-(da[grade == k]).sum() + (db[grade == k + 1]).sum()) / n for k in range(n_grades)])
        vw, vt = 0.9 * vw - rate * gw, 0.9 * vt - rate * 0.1 * gt
        w, t = w + vw, np.sort(t + vt)
    return Ordinal({int(h): float(x) for h, x in zip(columns, w, strict=True)}, t)


def learned(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    """Fit on at most about `sample` labelled documents: toxic ones up to a quarter, by a hash of the id.

    Only hashed word counts of sampled documents reach the driver. Labels that are null are left out.
    """
    own = labels.where(F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).dropDuplicates(["id"])
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    share = {1: min(1.0, sample / 4 / max(toxic, 1)), 0: min(1.0, (sample - min(toxic, sample / 4)) / max(clean, 1))}
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit("toxicity")), F.lit(1_000_000)) / 1e6
    picked = own.where(F.when(F.col("y") == 1, drawn < share[1]).otherwise(drawn < share[0]))
    # an integer for each sampled row: a bounded side
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [features(t) for t in part["text"].to_pylist()]
                yield pa.record_batch({"id": part["id"].cast(pa.string()), "y": part["y"], "h": pa.array([list(x) for x in found], pa.list_(pa.int32())), "n": pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))})

    got = texts.mapInArrow(hashed, "id string, y int, h array<int>, n array<int>").toArrow().sort_by("id").combine_chunks()
    lists = [got[c].combine_chunks() for c in ("h", "n")]
    row = np.repeat(np.arange(len(got)), np.diff(lists[0].offsets.to_numpy())) if len(got) else np.array([], int)
    return fit(row, *(x.flatten().to_numpy() for x in lists), got["y"].to_numpy())


def graded(docs: DataFrame, model: Ordinal, text: str = "text", reject: float = REJECT) -> DataFrame:
    """All rows and columns of docs with severity (expected grade), grade (the likeliest) and rejected.

    rejected: a grade above 0 has a probability of more than `reject`. Null and empty texts have no features and are graded by the
    thresholds alone. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("severity double, grade int, rejected boolean")
    def of(x: pa.Array) -> pa.Array:
        m = shared.value
        p = m.grades(np.array([m.raw(features(t)) for t in x.to_pylist()]))
        p[x.is_null().to_numpy(zero_copy_only=False)] = [1.0] + [0.0] * (p.shape[1] - 1)
        return pa.StructArray.from_arrays([pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1), pa.int32()), pa.array(1 - p[:, 0] > reject)], ["severity", "grade", "rejected"])

    out = docs.drop("severity", "grade", "rejected", "_graded").withColumn("_graded", of(F.col(text)))
    return out.withColumns({c: F.col("_graded")[c] for c in ("severity", "grade", "rejected")}).drop("_graded")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity, grade, rejected of every document."""
    docs = table(sf_dir, "documents", spark).select("doc_id", "text")
    return graded(docs, learned(docs, table(sf_dir, "labels", spark))).select("doc_id", "severity", "grade", "rejected")
