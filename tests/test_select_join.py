from conftest import AS_OF, by_id
from stocklens.functions import labels as L
from stocklens.operators import joins, ordering, select
from stocklens.plans import frame, sales


def ids(df):
    return sorted(r[0] for r in df.select("product_id").collect())


def test_active(tables):
    assert ids(select.active(tables.products)) == list(range(1, 10))
    assert len(ids(select.active(tables.products, include_inactive=True))) == 10


def test_select_inventory(tables):
    df = frame.analysis_frame(tables)
    assert len(ids(select.select_inventory(df, "Todas", "Todos"))) == 9
    assert ids(select.select_inventory(df, category="tools")) == [1, 2, 3]
    assert ids(select.select_inventory(df, "tools", "north")) == [1, 2]
    assert ids(select.select_inventory(df, states=[L.STATE_ICON[0], L.STATE_ICON[1]])) == [1, 2, 5, 6]


def test_facets(tables):
    found = select.facets(frame.analysis_frame(tables), "category")
    assert [r[0] for r in found.collect()] == ["paint", "tools"]


def test_stock_filters(tables):
    assert ids(select.critical(tables.products)) == [1, 2, 5, 6]
    # Exactly 60 days is not older than 60 days; few sales match as well.
    assert ids(select.slow_moving(tables.products, AS_OF)) == [4, 7, 9]
    # 45 days is not idle, 46 is; an unknown last sale never is.
    assert ids(select.idle(tables.products, AS_OF)) == [3, 4, 6, 7]


def test_notable_forecasts(tables):
    df = sales.forecast_frame(select.active(tables.products))
    assert ids(select.notable_forecasts(df)) == [1, 5, 6, 8]


def test_active_alerts_newest_first(tables):
    found = select.active_alerts(tables.alerts).collect()
    assert [r.alert_id for r in found] == [3, 1]


def test_inner_join_drops_unmatched(tables):
    assert ids(joins.join_dims(tables.products, tables.categories)) == [1, 2, 3, 4, 5, 6, 7, 10]


def test_enrich_keeps_every_product_and_its_flag(tables):
    out = joins.enrich(tables.products, tables.categories, tables.suppliers, tables.locations)
    found = by_id(out, "active", "category", "supplier", "supplier_active", "location_code")
    assert len(found) == 10
    assert found[8][1] is None and found[9] == (True, None, None, None, None)
    assert found[3] == (True, "tools", "south", False, "A-1-X")
    assert found[10][0] is False


def test_location_join_keeps_empty_locations(tables):
    found = by_id(
        joins.location_left_join(tables.locations, tables.products), "products", "units",
        key="location_id",
    )
    assert found == {1: (3, 15), 2: (5, 77), 3: (None, None)}


def test_supplier_join_drops_suppliers_without_products(tables):
    out = joins.supplier_join(tables.suppliers, tables.products)
    assert {r.supplier_id for r in out.collect()} == {1, 2, 3}


def test_null_placement(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "product_id long, v int")
    assert [r[0] for r in ordering.top_first(df, "v").collect()] == [2, 3, 1]
    assert [r[0] for r in ordering.top_first(df, "v", nulls_last=True).collect()] == [3, 1, 2]
    assert [r[0] for r in df.orderBy(ordering.asc("v")).collect()] == [1, 3, 2]


def test_top_k_is_not_a_full_sort(tables):
    plan = sales.top10_sales(tables)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_equal_sales_at_the_border_are_cut_by_id(tables):
    top = ordering.top_k(select.active(tables.products), 2, "sales_month").collect()
    assert [r.product_id for r in top] == [7, 8]
    top = ordering.top_k(select.active(tables.products), 3, "sales_month").collect()
    assert top[-1].product_id == 1
