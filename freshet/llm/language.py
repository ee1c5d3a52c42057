"""Language of texts by string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import table, utf8

#: n-grams of 1 to LONGEST bytes; hashed to 2^BITS places. Training texts at most, over all languages; landmarks; languages.
LONGEST, BITS, SAMPLE, LANDMARKS, MAX_LANGUAGES, RIDGE = 4, 14, 2000, 128, 500, 1e-4
UND = "und"
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def presence(texts: list[bytes]) -> np.ndarray:
    """One row for each text, with 1 at the places of its n-grams. Case is folded and what is no letter is a space, for ASCII."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    b = _FOLD[np.frombuffer(b"".join(texts), np.uint8)].astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) << BITS, n)
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    flat = out.reshape(-1)
    code = np.zeros(len(b), np.uint32)
    for k in range(LONGEST):
        end = len(b) - k
        if end <= 0:
            break
        code = code[:end] | b[k:] << np.uint32(8 * k)
        place = ((code + np.uint32(k * 7919)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        own = row[:end] == row[k:]
        flat[(row[:end] + place)[own]] = 1
    return out


def slices(texts: list[bytes], rows: int = 256, size: int = 2_000_000) -> Iterator[list[bytes]]:
    own, total = [], 0
    for t in texts:
        if own and (len(own) == rows or total + len(t) > size):
            yield own
            own, total = [], 0
        own.append(t)
        total += len(t)
    if own:
        yield own


class Model:
    """Landmarks and, for each language, weights of the kernels with them."""

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, languages: list[str]) -> None:
        self.landmarks, self.weights, self.languages = np.packbits(landmarks.astype(bool), axis=1), weights, languages
        self._dense = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def kernels(self, x: np.ndarray) -> np.ndarray:
        """Shared n-grams over the root of both texts' numbers of n-grams."""
        if self._dense is None:
            dense = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
            self._dense = np.ascontiguousarray((dense / np.sqrt(np.maximum(dense.sum(1), 1))[:, None]).T)
        return (x @ self._dense) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]

    def values(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each language."""
        return np.concatenate([self.kernels(presence(s)) @ self.weights for s in slices(texts)] or [np.zeros((0, len(self.languages)))])


def fit(x: np.ndarray, languages: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regression on the Nystroem map of n_landmarks rows, taken in turn from each language."""
    names = sorted(set(languages))
    lang = np.array([names.index(v) for v in languages])
    turn = np.empty(len(lang), int)
    for k in range(len(names)):
        turn[lang == k] = np.arange((lang == k).sum())
    marks = np.lexsort((lang, turn))[:n_landmarks]
    model = Model(x[marks], np.zeros((len(marks), len(names))), names)
    k_all = np.concatenate([model.kernels(x[i : i + 256].astype(np.float32)) for i in range(0, len(x), 256)]).astype(np.float64)
    value, vector = np.linalg.eigh(k_all[marks])
    good = value > 1e-6 * value.max()
    half = vector[:, good] / np.sqrt(value[good])
    phi = k_all @ half
    each = 1.0 / np.bincount(lang, minlength=len(names))[lang]
    y = (lang[:, None] == np.arange(len(names))).astype(float)
    solved = np.linalg.solve((phi * each[:, None]).T @ phi + ridge * len(names) * np.eye(phi.shape[1]), (phi * each[:, None]).T @ y)
    model.weights = half @ solved
    return model


def learned(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on about `sample` texts with a known language, in equal parts of the languages; None without any.

    Texts are drawn by a hash of id and text. Each gives two rows: the whole text, and for the sake of short ones, an excerpt of 30 to 200 bytes.
    Executors turn texts to rows of 2^BITS bits, and only these reach the driver. Beyond MAX_LANGUAGES the most frequent count.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES)
    per = {r["lang"]: r["n"] for r in counts.collect()}
    if not per:
        return None
    each = max(2, sample // len(per))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, 1.2 * each / n)) for k, n in per.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(1_000_000_000)) / 1e9
    picked = known.withColumn("drawn", drawn).join(F.broadcast(shares), "lang").where("drawn < share").select("lang", "drawn", "text")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                whole = utf8(part["text"])
                excerpts = []
                for t in whole:
                    h = zlib.crc32(t)
                    size = 30 + h % 171
                    at = (h >> 8) % max(1, len(t) - size)
                    excerpts.append(t[at : at + size])
                packs = [np.packbits(np.concatenate([presence(s) for s in slices(x)]).astype(bool), axis=1) for x in (whole, excerpts)]
                yield pa.record_batch({"lang": part["lang"], "drawn": part["drawn"], **{k: pa.array([r.tobytes() for r in p], pa.binary()) for k, p in zip(("whole", "part"), packs, strict=True)}})

    got = picked.mapInArrow(bits, "lang string, drawn double, whole binary, part binary").toArrow().sort_by([("lang", "ascending"), ("drawn", "ascending")])
    x = np.unpackbits(np.frombuffer(b"".join([*got["whole"].to_pylist(), *got["part"].to_pylist()]), np.uint8).reshape(2 * len(got), -1), axis=1)
    return fit(x, 2 * got["lang"].to_pylist())


def identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All rows and columns of docs with lang_pred and score, the language's share (0 to 1) of the clipped regression values.

    Null texts and texts without a letter are `und` with score 0, and so is everything without a model. Columns of these names
    are replaced. Whole texts are used, in slices of a few hundred texts.
    """
    out = docs.drop("lang_pred", "score", "_found")
    if model is None:
        return out.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def of(x: pa.Array) -> pa.Array:
        m = shared.value
        value = np.clip(m.values(utf8(x)), 0, 1)
        best = value.argmax(axis=1) if len(value) else np.zeros(0, int)
        share = value.max(axis=1, initial=0) / np.maximum(value.sum(axis=1), 1e-9)
        return pa.StructArray.from_arrays([pa.array([m.languages[i] for i in best], pa.string()), pa.array(np.clip(share, 0, 1))], ["lang_pred", "score"])

    read = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = out.withColumn("_found", of(F.when(read, F.col(text))))
    return out.withColumns({"lang_pred": F.when(read, F.col("_found.lang_pred")).otherwise(UND), "score": F.when(read, F.col("_found.score")).otherwise(0.0)}).drop("_found")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; fitted on those that aren't held out."""
    docs = table(sf_dir, "documents", spark).select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    model = learned(docs.where(~held))
    return identified(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
