"""Hard negatives against SQL on vectors with ties, repeated rows, nulls and odd lengths."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from freshet.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed, n=400, dim=6):
    rng = random.Random(seed)
    hot = [1.0] * dim
    out = []
    for i in range(n):
        v = hot if rng.random() < 0.3 else [rng.choice((0.0, 0.25, 0.5, 0.75, -0.25, 1.0, 0.9)) for _ in range(dim)]
        out.append((i, v, rng.choice((0, 1, 2, 9, 0))))
    return out


def at(spark, path, rows):
    pq.write_table(spark.createDataFrame(rows, SCHEMA).toArrow(), path / "embeddings.parquet")
    pq.write_table(spark.createDataFrame([], "doc_id long").toArrow(), path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("seed", range(3))
def test_against_sql(spark, tmp_path, monkeypatch, seed):
    if seed:
        monkeypatch.setattr(negatives, "LEAST_ROWS", 60)
        monkeypatch.setattr(negatives, "ANCHORS", 3)
        monkeypatch.setattr(negatives, "SCORES", 500)
    d = at(spark, tmp_path, vectors(seed))
    out = negatives.op13_hard_negatives(spark, d)
    assert out.count() > 50
    ok, message = compare(connect(d), out, negatives.SQL)
    assert ok, message


def test_edges(spark, tmp_path):
    rows = vectors(7, 120) + vectors(7, 120)[:60]  # repeated rows, anchors among them
    rows += [(None, [0.5] * 6, 1), (None, None, 2), (None, [0.75] * 6, 0), (500, None, 1), (550, [1.0, None], 1), (600, [float("nan")] * 6, 1), (650, [float("inf")] * 6, 2), (700, [1.0] * 6, None),
             (750, [1.0, 1.0], 1), (800, [], 2), (850, [1.0] * 9, 2), (50, [0.9] * 6, 2), (900, [-1.0] * 6, 9), (950, [-1.0] * 6, 9)]
    d = at(spark, tmp_path, rows)
    ok, message = compare(connect(d), negatives.op13_hard_negatives(spark, d), negatives.SQL)
    assert ok, message


def test_empty_and_clashing_names(spark, tmp_path):
    d = at(spark, tmp_path, [])
    assert negatives.op13_hard_negatives(spark, d).count() == 0
    df = spark.createDataFrame(vectors(1), SCHEMA).withColumns({c: F.lit(None) for c in ("id", "v", "asks", "anchor", "slot", "score", "part", "team")})
    assert negatives.mined(df, F.col("vec_id") % 50 == 0).count() > 50


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for top in (100, 10**6, 2**28, 2**31, 2**40):
        a, b = (rng.integers(-top, top, (n, 5)) for n in (7, 11))
        want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]
        if max(abs(x) for r in want for x in r) < 2**63:
            got = np.concatenate([s for _, s in negatives.products(a, b)])
            assert got.tolist() == want
        else:
            with pytest.raises(OverflowError):
                list(negatives.products(a, b))


def test_leading():
    score, group = np.array([5, 5, 1, 7, 5, 2]), np.array([0, 0, 1, 1, 0, 1])
    assert negatives.leading(score, group, 2).tolist() == [0, 1, 3, 5]
