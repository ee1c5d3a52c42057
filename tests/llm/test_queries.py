"""Every text query: against SQL where there is some, on small tables, edge cases and empty tables."""

import pytest
from oracle import compare, connect

from freshet.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
NATIVE = ("op3_quality_rules", "op4_fingerprints", "op10_url_filters")


@pytest.mark.parametrize("name", list(SQL))
@pytest.mark.parametrize("where", ["small", "edge", "none"])
def test_against_sql(spark, edge_dir, none_dir, name, where):
    at = {"small": SF, "edge": edge_dir, "none": none_dir}[where]
    ok, message = compare(connect(at), QUERIES[name](spark, at), SQL[name])
    assert ok, message


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SQL])
def test_whole_table(spark, edge_dir, none_dir, name):
    for at in (SF, edge_dir, none_dir):
        out = QUERIES[name](spark, at)
        assert out.count() == spark.read.parquet(f"{at}/documents.parquet").count()


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for other in ("Python", "InArrow", "InPandas", "CartesianProduct", "NestedLoop"):
        assert other not in plan
