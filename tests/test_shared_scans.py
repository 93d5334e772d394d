"""Scans that several reports or rules share."""

from pathlib import Path

import pytest

import inventory_queries as queries
from stocklens.plans import suite
from stocklens.sources import quality, star

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_read_one_snapshot(spark):
    """Each report's plan scans sales; from shared tables none does, and results are the same."""
    tables = star.star_tables(spark, SF)
    apart = suite.run_report_suite(tables)
    shared = suite.run_report_suite(suite.shared_tables(star.star_tables(spark, SF)))
    for name, outcome in apart.items():
        assert "l_partkey" in plan(outcome.result) and "l_partkey" not in plan(shared[name].result)
        assert sorted(map(str, shared[name].result.collect())) == sorted(map(str, outcome.result.collect()))


def test_a_shared_table_is_written_once(spark, monkeypatch):
    calls = []
    real = suite.materialized
    monkeypatch.setattr(suite, "materialized", lambda df, label: (calls.append(label), real(df, label))[1])
    outcomes = suite.run_report_suite(suite.shared_tables(star.star_tables(spark, SF)))
    assert len(outcomes) == 4 and calls == ["shared-products"]


def test_rules_of_a_table_take_one_scan(spark, tables):
    """Each cached table of the fixtures is read once, whatever the number of its rules."""
    report = quality.check_integrity(tables.as_dict())
    assert plan(report).split("== Initial Plan ==")[0].count("InMemoryTableScan") == len(tables.names())
    assert report.count() > 30


def test_integrity_counts_rows_of_every_kind(spark, tables):
    more = dict(tables.as_dict())
    products = more["products"]
    more["products"] = products.union(products.where("product_id <= 3")).union(
        products.where("product_id = 1"))
    found = {(r.table_name, r.rule, r.column_name): r.violations
             for r in quality.check_integrity(more).collect()}
    assert found["products", "duplicate_key", "product_id"] == 4
    before = {(r.table_name, r.rule, r.column_name): r.violations
              for r in quality.check_integrity(tables.as_dict()).collect()}
    assert before["products", "duplicate_key", "product_id"] == 0
    assert before["products", "orphan_key", "category_id"] == 1
    assert set(found) == set(before)
    assert queries.MOVEMENTS["check_integrity"](spark, SF).count() > 0
