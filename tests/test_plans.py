"""What the physical plans must and must not hold."""

import re
from pathlib import Path

import pytest

import inventory_queries as registered
from stocklens.plans import kpis, sales
from stocklens.sources import star

DIRECTORY = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


RELATIONAL = {
    **registered.REPORTS, **registered.MEASURES, **registered.CLASSES, **registered.OPERATORS
}


@pytest.mark.parametrize("name", sorted(RELATIONAL))
def test_relational_plans_stay_in_the_engine(spark, name):
    text = plan(RELATIONAL[name](spark, DIRECTORY))
    for bad in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_scans_are_pruned_and_filtered(spark):
    tables = star.star_tables(spark, DIRECTORY, main_supplier=False)
    text = plan(kpis.executive_kpis(tables))
    line = next(s for s in re.findall(r"ReadSchema: struct<[^>]*>", text) if "l_partkey" in s)
    assert line == "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>"
    assert "LessThanOrEqual(l_shipdate" in text


def test_dimensions_are_broadcast_by_size_not_by_hint(spark):
    report = sales.top10_sales(star.star_tables(spark, DIRECTORY))
    logical = report._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in logical
    assert "BroadcastHashJoin" in plan(report)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = sales.top10_sales(star.star_tables(spark, DIRECTORY))
        assert "SortMergeJoin" in plan(large) and large.collect() == report.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recent_movements_take_only_the_top(spark):
    assert "TakeOrderedAndProject" in plan(registered.QUERIES["recent_movements"](spark, DIRECTORY))
