"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from freshet.plans.catalog import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog().queries, catalog().sql


@pytest.fixture(scope="module")
def duck():
    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas"):
        assert costly not in plan
    if name not in SQL:
        assert df.count() > 0
        return
    ok, message = compare(duck, df, SQL[name])
    assert ok, message


def test_samples_stay_in_place(spark):
    """Joining samples to day tables moves only the day tables."""
    plan = QUERIES["j1_samples_to_load_as_na_zero"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # the daily flow, and the final grouping


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["a3_fan_daily"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_linenumber:int,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
