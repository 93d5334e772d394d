from decimal import Decimal

import pytest

from conftest import AS_OF, by_id
from stocklens.functions import labels as L
from stocklens.plans import alerts, finance, frame, kpis, sales, stock, suite, views
from stocklens.sources.tables import Tables


@pytest.fixture(scope="module")
def selection(tables):
    return frame.analysis_frame(tables).cache()


def test_category_profitability(tables):
    out = by_id(
        finance.category_profitability(tables), "products", "stock", "stock_value",
        "profit_month", "units_month", key="category",
    )
    assert out["tools"] == (3, 15, Decimal("50.00"), Decimal("106.00"), 14)
    assert out["paint"] == (4, 46, Decimal("116.00"), Decimal("45.00"), 35)


def test_supplier_performance(tables):
    out = by_id(
        finance.supplier_performance(tables), "products", "critical_products", key="supplier"
    )
    assert out == {"north": (4, 2), "south": (3, 1), "east": (1, 1)}


def test_location_utilization(tables):
    out = by_id(
        stock.location_utilization(tables), "location_code", "products", "units",
        "occupancy_pct", key="location_id",
    )
    assert out[1] == ("A-1-X-1", 3, 15, 30.0)
    assert out[3] == ("B-1-X-", 0, None, None)


def test_urgent_reorder_starts_with_empty_stock(tables):
    rows = stock.urgent_reorder(tables).collect()
    assert [r.product_id for r in rows] == [1, 6, 5, 2]


def test_executive_kpis(tables):
    k = kpis.executive_kpis(tables).first()
    assert (k.products, k.in_stock, k.critical_products, k.units_month) == (9, 8, 4, 70)
    assert k.revenue_month == Decimal("375.00")


def test_abc(tables):
    rows = finance.abc_analysis(tables).collect()
    assert [r.product_id for r in rows] == [1, 6, 7, 3, 5]
    assert rows[0].cumulative_pct == pytest.approx(63.29)
    assert rows[-1].cumulative_pct == 100.0
    small = finance.abc_analysis(tables, rows_per_cell=2).collect()
    assert small == rows


def test_abc_counts_add_up(selection):
    counts = finance.abc_class_counts(selection).collect()
    assert sum(r.products for r in counts) == selection.filter("sales_month > 0").count()


def test_abc_shares_grow_to_the_whole(selection):
    shares = [r.cumulative_pct for r in finance.abc_filtered(selection, rows_per_cell=3).collect()]
    assert shares == sorted(shares) and shares[-1] == 100.0


def test_auto_alerts(tables):
    rows = alerts.auto_alerts(tables, AS_OF).collect()
    kinds = [(r.alert_kind, r.product_id, r.priority) for r in rows]
    assert kinds == [
        (L.ALERT_REORDER, 1, "CRÍTICA"), (L.ALERT_REORDER, 5, "ALTA"),
        (L.ALERT_REORDER, 6, "ALTA"), (L.ALERT_REORDER, 2, "MEDIA"),
        (L.ALERT_IDLE, 4, "ALTA"), (L.ALERT_IDLE, 7, "MEDIA"),
        (L.ALERT_IDLE, 3, "BAJA"), (L.ALERT_IDLE, 6, "BAJA"),
    ]
    assert rows[0].message == "Stock bajo: 0 unidades (mínimo: 5)"
    assert rows[4].message == "Producto sin ventas por 91 días" and rows[4].lead_days is None


def test_alerts_read_products_once(tables):
    plan = alerts.auto_alerts(tables, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_monthly_comparison(tables):
    row = sales.monthly_comparison(tables).first()
    assert (row.units_month, row.units_prev_month) == (70, 53)
    assert row.units_growth_pct == 32.08


def test_seasonal_patterns(tables):
    rows = sales.seasonal_patterns(tables).collect()
    assert all(r.sales_year > 0 for r in rows)
    order = {"PICO_ALTA": 1, "VALLE_BAJA": 2, "NORMAL": 3}
    assert [order[r.season] for r in rows] == sorted(order[r.season] for r in rows)


def test_views(spark, tables):
    assert views.critical_stock(tables).count() == 9
    names = views.register(tables)
    assert spark.sql(f"SELECT * FROM {names[1]}").count() == 9
    ranks = by_id(views.top_products(tables), "rank_sales", "rank_profit")
    assert ranks[7][0] == ranks[8][0] == 1 and ranks[1][0] == 3
    assert ranks == by_id(views.top_products(tables, rows_per_cell=2), "rank_sales", "rank_profit")


def test_business_kpis(selection):
    k = kpis.business_kpis(selection).first()
    assert (k.products, k.critical_products, k.no_sales_products) == (9, 4, 2)
    assert k.critical_pct == pytest.approx(400 / 9)
    assert k.profit_month == k.revenue_month - k.cost_month


def test_kpis_of_an_empty_selection(selection):
    k = kpis.business_kpis(selection.filter("false")).first()
    assert (k.products, k.critical_pct, k.net_margin_pct, k.mean_turnover) == (0, 0.0, 0.0, 0.0)


def test_insights(selection):
    found = kpis.insights(selection).collect()
    titles = [r.title for r in found]
    assert L.INSIGHT_CRITICAL[1] in titles and L.INSIGHT_GROWTH[1] in titles
    assert found[0].message.startswith("44.4% ")
    assert [r.position for r in found] == list(range(len(found)))


def test_critical_reports(selection):
    rows = stock.critical_list(selection).collect()
    assert [r.product_id for r in rows] == [1, 6, 5, 2]
    assert rows[-1].days_of_stock == L.NO_SALES
    summary = stock.critical_summary(selection).first()
    assert (summary.out_of_stock, summary.critical) == (1, 3)
    total = stock.purchase_total(selection).first().investment
    assert total == sum(r.investment for r in stock.purchase_recommendations(selection).collect())


def test_trend_kpis_agree_with_the_listing(selection):
    k = sales.trend_forecast_kpis(selection).first()
    everything = sales.forecast_frame(selection).collect()
    assert k.suggested_purchase == sum(r.suggested_purchase for r in everything)
    assert k.at_risk == sum(r.risk == L.FUTURE_STOCK[0] for r in everything)


def test_turnover_report(selection):
    rows = stock.turnover_report(selection).collect()
    months = [r.months_of_stock for r in rows]
    assert months == sorted(months, reverse=True) and len(rows) == 7


def test_no_movement(selection):
    rows = stock.no_movement_report(selection).collect()
    assert [r.product_id for r in rows] == [9, 4, 2]
    total = stock.no_movement_total(selection).first().tied_up_value
    assert total == sum(r.tied_up_value for r in rows)


def test_state_counts_add_up(selection):
    counts = stock.stock_state_distribution(selection).collect()
    assert sum(r.products for r in counts) == 9


def test_suite_survives_a_failing_report(tables):
    def broken(t):
        return t.products.select("no_such_column")

    found = suite.run_report_suite(tables, {"bad": broken, "good": kpis.executive_kpis})
    assert found["bad"].result is None and found["bad"].error is not None
    assert found["good"].result.count() == 1
    assert set(suite.run_report_suite(tables)) == set(suite.STANDARD)


def test_missing_table_is_named(tables):
    with pytest.raises(AttributeError, match="locations"):
        Tables(products=tables.products).locations
    with pytest.raises(ValueError, match="unknown"):
        Tables(nonsense=tables.products)


def test_results_do_not_depend_on_partitions(spark, tables):
    before = finance.category_profitability(tables).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert finance.category_profitability(tables).collect() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
