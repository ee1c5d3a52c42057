"""Exact quantiles and ranks against numpy, with hot values and several layouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators.order import exact_quantiles, exact_rank

PROBS = {"p05": 0.05, "p50": 0.5, "p90": 0.9, "lo": 0.0, "hi": 1.0}


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, id long, v double")


@pytest.mark.parametrize("cells", [1, 7, 1 << 16])
def test_quantiles_match_numpy(spark, cells):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.zeros(500), rng.lognormal(0, 3, 700), -rng.random(33), [1e9]])  # a third are zeros
    df = frame(spark, values).unionByName(frame(spark, [5.0], "single")).unionByName(frame(spark, [2.0, 4.0], "two"))
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", PROBS, cells).collect()}
    for name, p in PROBS.items():
        assert got["a"][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)
        assert got["single"][name] == 5.0
    assert got["two"]["p50"] == 3.0
    whole = exact_quantiles(df.where("k = 'a'"), [], "v", PROBS, cells).first()
    assert whole["p90"] == pytest.approx(np.percentile(values, 90), rel=1e-12)


def test_quantiles_skip_missing_and_constant(spark):
    df = frame(spark, [3.0, 3.0, 3.0]).unionByName(spark.createDataFrame([("a", 9, None)], "k string, id long, v double"))
    assert exact_quantiles(df, ["k"], "v", PROBS).first()["p50"] == 3.0


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("parts", [1, 9])
def test_rank_with_hot_ties(spark, descending, parts):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.zeros(400), np.round(rng.normal(0, 5, 800), 1)])
    rows = exact_rank(frame(spark, values).repartition(parts), ["k"], "v", ["id"], descending, 64).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(values) + 1))
    in_order = [r["v"] for r in sorted(rows, key=lambda r: r["rank"])]
    assert in_order == sorted(values.tolist(), reverse=descending)
    assert {r["n"] for r in rows} == {len(values)}


def test_rank_does_not_depend_on_layout(spark):
    df = frame(spark, [1.0, 0.0, 0.0, 2.0, 0.0, -1.0] * 20)
    a = exact_rank(df.repartition(1), [], "v", ["id"]).select("id", "rank")
    b = exact_rank(df.repartition(11), [], "v", ["id"]).select("id", "rank")
    assert a.join(b, "id").where(a["rank"] != b["rank"]).count() == 0


def test_rank_of_dates_as_numbers(spark):
    df = spark.range(100).withColumn("v", (F.col("id") % 10).cast("double"))
    assert exact_rank(df, [], "v", ["id"]).agg(F.max("rank")).first()[0] == 100


def test_equal_rows_are_numbered_without_a_hot_task(spark):
    """A third of all rows are equal in every column: their numbers follow each other and come from one counted row."""
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    out = exact_rank(df, [], "v")
    rows = sorted((r["rank"], r["v"], r["n"]) for r in out.collect())
    assert [r[0] for r in rows] == list(range(1, 901)) and {r[2] for r in rows} == {900}
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
