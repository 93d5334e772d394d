"""The mapping of the star schema on values that the test tables do not hold."""

import pytest
from pyspark.errors import AnalysisException

from inventory_queries import QUERIES
from stocklens.operators.joins import join_dims
from stocklens.sources import star

BIG = 2**62 + 11


@pytest.fixture(scope="module")
def directory(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("star"))
    kinds = ["STANDARD ANODIZED TIN", "PROMO", "never seen", "", "Été", "x" * 300]
    part = [(i, f"part {i}", f"Brand#{i % 3 + 10}", kinds[i % len(kinds)], 1 + i, 100.0 + i)
            for i in range(1, 61)]
    spark.createDataFrame(part, star.STAR_SCHEMAS["part"]).write.parquet(f"{out}/part.parquet")
    keys = [7, 2**31 + 5, BIG, 2**63 - 1]
    spark.createDataFrame([(k, f"supplier {k}") for k in keys], star.STAR_SCHEMAS["supplier"]
                          ).write.parquet(f"{out}/supplier.parquet")
    lines = [(part_key, keys[part_key % 4], day, 5.0) for part_key in range(1, 61)
             for day in ("2001-07-20", "2001-06-20", "2000-09-01", "1999-01-01")]
    # Equal quantities: the lowest key counts.
    lines += [(1, 7, "2001-07-21", 20.0), (2, 2**31 + 5, "2001-07-21", 20.0)]
    rows = spark.createDataFrame(lines, "p long, s long, day string, q double").selectExpr(
        "p as l_orderkey", "p as l_partkey", "s as l_suppkey", "1 as l_linenumber",
        "q as l_quantity", "q as l_extendedprice", "'N' as l_returnflag",
        "cast(day as timestamp_ntz) as l_shipdate")
    rows.write.parquet(f"{out}/lineitem.parquet")
    return out


def test_any_part_type_is_a_category_of_its_own(spark, directory):
    t = star.star_tables(spark, directory)
    assert t.categories.count() == 6 == t.categories.select("category_id").distinct().count()
    joined = join_dims(t.products, t.categories)
    assert joined.count() == 60
    assert {r.category for r in joined.collect()} == {r.category for r in t.categories.collect()}


def test_main_suppliers_of_any_key(spark, directory):
    keys = [7, 2**31 + 5, BIG, 2**63 - 1]
    found = {r.product_id: r.supplier_id for r in star.products(spark, directory).collect()}
    expected = {i: keys[i % 4] for i in range(1, 61)} | {1: 7, 2: 2**31 + 5}
    assert found == expected


def test_look_back_reads_and_offers_less(spark, directory):
    full = star.products(spark, directory, main_supplier=False)
    for days, missing in ((30, 4), (60, 3), (90, 2), (365, 1)):
        some = star.products(spark, directory, main_supplier=False, days=days)
        assert len(full.columns) - len(some.columns) == missing
        kept = some.columns
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(l_shipda" in plan
        assert sorted(map(tuple, some.collect()), key=str) == sorted(
            map(tuple, full.select(*kept).collect()), key=str)
    with pytest.raises(AnalysisException):
        some.select("last_sale")
    with pytest.raises(ValueError, match="whole history"):
        star.products(spark, directory, days=30)


@pytest.mark.parametrize("name", [
    "executive_kpis", "category_profitability", "top15_profitable", "sales_projection",
    "monthly_comparison",
])
def test_reports_read_only_the_days_they_need(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "GreaterThanOrEqual(l_shipda" in plan.executedPlan().toString()
