import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from freshet.functions.sums import steady_mean, steady_sum
from freshet.operators import compare, duration, fit, pairing, shift
from freshet.plans import fit as fitq
from freshet.plans import views


def _rows(n):
    rng = random.Random(5)
    return [(rng.randrange(17), rng.randrange(1, 8), float(rng.randrange(1, 51)), round(rng.uniform(900, 105000), 2), rng.randrange(11) / 100, rng.randrange(9) / 100,
             dt.datetime(1996, 3, 1 + rng.randrange(3))) for _ in range(n)]


@pytest.fixture(scope="module")
def orders_of_rows(spark, tmp_path_factory):
    """The same line items in two orders, as the same shuffle may bring them."""
    rows = _rows(6000)
    schema = "l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    dirs = []
    for i, some in enumerate((rows, rows[::-1])):
        dirs.append(str(tmp_path_factory.mktemp(f"order{i}")))
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{dirs[i]}/lineitem.parquet")
    return dirs


def test_sum_is_exact_in_any_order(spark):
    rng = random.Random(1)
    v = [rng.uniform(-1e6, 1e6) * 10 ** rng.randint(-12, 2) for _ in range(3000)]
    got = {tuple(spark.createDataFrame([(x,) for x in some], "x double").coalesce(1).agg(steady_sum("x"), steady_mean("x")).first()) for some in (v, v[::-1], sorted(v))}
    assert got == {(math.fsum(v), math.fsum(v) / len(v))}


@pytest.mark.parametrize("v", [[], [None], [None, 3.0], [1e300, 1.5], [float("inf"), 1.0], [float("nan"), 1.0], [float("inf"), float("-inf")], [3e-25], [-0.3], [2e9, -0.25]])
def test_odd_values_sum_as_doubles_do(spark, v):
    row = spark.createDataFrame([(x,) for x in v], "x double").agg(steady_sum("x").alias("s"), F.sum("x").alias("t"), steady_mean("x").alias("a"), F.avg("x").alias("b")).first()
    assert repr(row.s) == repr(row.t) and repr(row.a) == repr(row.b)


def test_frames_read_in_another_order_do_not_differ(spark, orders_of_rows):
    a, b = (views.sub(spark, d) for d in orders_of_rows)
    cols = ["wyld", "syld", "orgn", "orgp", "solp", "sedp", "nsurq"]
    assert {r.n_different for r in compare.difference_counts(a, b, ["sub", "date"], cols).collect()} == {0}
    assert compare.difference_metrics(a, b, ["sub", "date"], cols).count() == 0


def test_runs_of_the_ensemble_lie_inside_it_in_another_order(spark, orders_of_rows):
    a, b = orders_of_rows
    pairs = pairing.pair_scenarios(fitq.scenarios(spark, a), fitq.reach_fan(spark, b), by=fitq.KEYS)
    got = shift.envelope_widths(pairs, fitq.reach_fan(spark, b), keys=[*fitq.KEYS, "scenario"]).collect()
    assert got and {r.coverage_fraction for r in got} == {1.0}


def _samples(spark):
    """Daily means of the same samples in two orders."""
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(2)}", "F", dt.datetime(1996, 3, 1 + rng.randrange(20)), rng.uniform(0, 400)) for _ in range(4000)]
    schema = "station string, analyte string, date timestamp_ntz, value_num double"
    return [pairing.measured_daily(spark.createDataFrame(some, schema).coalesce(1)) for some in (rows, rows[::-1])]


def test_daily_means_are_the_same_in_another_order(spark):
    a, b = _samples(spark)
    assert a.count() == 40 and a.exceptAll(b).count() == 0
    # ranks join the values with themselves, a histogram measures from its own least value
    assert sorted(duration.measured_on_order(a).collect()) == sorted(duration.measured_on_order(b).collect())
    hist = [sorted(fit.residual_histogram(x.withColumn("pred", F.lit(0.0)), 30, ["station"]).collect()) for x in (a, b)]
    assert hist[0] == hist[1] and min(r.bin for r in hist[0]) == 0


def test_days_of_equal_sums_keep_the_order_of_dates(spark):
    """0.1 + 0.2 lies above 0.3 as a double; a difference in the tenth digit isn't the rounding of a sum."""
    values = [0.3, 0.1 + 0.2, 0.3 * (1 + 1e-9), 0.3, -0.5, -(0.1 + 0.2), -0.3]
    bands = spark.createDataFrame([(1, dt.date(2000, 1, 1 + i), x) for i, x in enumerate(values)], "rch int, date date, p50 double").select(
        "*", F.col("p50").alias("mean"), (F.col("p50") - 1).alias("min"), (F.col("p50") + 1).alias("max"))
    for ref in ("p50", "mean"):
        got = duration.paired_duration(bands, ["rch"], ref, ["p50"]).orderBy("rank").collect()
        assert [r.date.day for r in got] == [3, 1, 2, 4, 6, 7, 5]
        assert [r.p50 for r in got] == [values[r.date.day - 1] for r in got]  # the bands stay as they are
