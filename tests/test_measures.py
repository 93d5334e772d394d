from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, by_id
from stocklens.functions import measures as M


def test_margin_guards_zero_price(tables):
    out = by_id(M.with_margin(tables.products), "unit_profit", "margin_pct", "stock_value")
    assert out[1] == (Decimal("10.00"), 50.0, Decimal("0.00"))
    assert out[3] == (Decimal("1.50"), 37.5, Decimal("25.00"))
    assert out[5] == (Decimal("-1.00"), None, Decimal("3.00"))


def test_revenue(tables):
    out = by_id(M.with_revenue(tables.products), "revenue_month", "cost_month")
    assert out[1] == (Decimal("200.00"), Decimal("100.00"))
    assert out[4] == (Decimal("0.00"), Decimal("0.00"))


def test_turnover_and_months(tables):
    p = tables.products
    assert by_id(M.with_turnover(p), "turnover_month")[1] == 0.0
    assert by_id(M.with_turnover(p), "turnover_month")[6] == 5.0
    plain = by_id(M.with_months_of_stock(p), "months_of_stock")
    strict = by_id(M.with_months_of_stock(p, need_stock=True), "months_of_stock")
    filled = by_id(M.with_months_of_stock(p, no_sales=999), "months_of_stock")
    assert (plain[1], strict[1], filled[1]) == (0.0, None, 0.0)
    assert (plain[2], strict[2], filled[2]) == (None, None, 999.0)
    assert plain[3] == strict[3] == filled[3] == 2.5


def test_annual_turnover(tables):
    p = tables.products
    rounded = by_id(M.with_annual_turnover(p), "turnover_year")
    raw = by_id(M.with_annual_turnover(p, digits=None), "turnover_year")
    assert (rounded[1], rounded[2]) == (0.0, 0.0)
    assert rounded[8] == 7.74 and raw[8] == pytest.approx(240 / 31)


def test_days_of_stock(tables):
    out = tables.products.select(
        "product_id", M.days_of_stock().alias("days"), M.days_of_stock_text().alias("text")
    )
    found = by_id(out, "days", "text")
    assert found[2] == (None, "Sin ventas")
    assert found[3] == (75.0, "75.0")


def test_growth_and_projection(tables):
    p = tables.products
    growth = by_id(M.with_growth(p), "growth_pct")
    assert (growth[1], growth[2], growth[3], growth[4]) == (25.0, -100.0, 0.0, 0.0)
    up = by_id(M.with_projection(p), "projection")
    even = by_id(M.with_projection(p, half_even=True), "projection")
    # 5 after 2: 12.5; 10 after 8: 12.5; no base: the month itself.
    assert (up[5], even[5]) == (13, 12)
    assert (up[6], even[6]) == (13, 12)
    assert (up[3], even[3]) == (4, 4)


def test_reorder_and_purchase(tables):
    out = by_id(M.with_reorder_qty(tables.products), "reorder_qty", "investment")
    assert out[1] == (10, Decimal("100.00"))
    assert out[4] == (-1, Decimal("-7.00"))
    bought = M.with_suggested_purchase(M.with_projection(tables.products))
    assert by_id(bought, "suggested_purchase")[1] == 13
    assert by_id(bought, "suggested_purchase")[4] == 0


def test_idle(tables):
    out = by_id(M.with_idle(tables.products, AS_OF), "idle_days", "clearance_price")
    assert out[2] == (45, Decimal("5.60"))
    assert out[8][0] is None


def test_location_code_keeps_separators(tables):
    out = tables.locations.select(
        "location_id", M.location_code().alias("four"),
        M.location_code(("section", "aisle", "shelf")).alias("three"),
    )
    found = by_id(out, "four", "three", key="location_id")
    assert found == {1: ("A-1-X-1", "A-1-X"), 2: ("A-2--1", None), 3: ("B-1-X-", "B-1-X")}


@pytest.mark.parametrize("value,digits,up,even", [
    (2.5, 0, 3.0, 2.0), (-2.5, 0, -3.0, -2.0), (0.575, 2, 0.58, 0.57), (0.125, 2, 0.13, 0.12),
])
def test_rounding(spark, value, digits, up, even):
    row = spark.range(1).select(
        M.rounded(F.lit(value), digits), M.rounded(F.lit(value), digits, half_even=True)
    ).first()
    assert tuple(row) == (up, even)
