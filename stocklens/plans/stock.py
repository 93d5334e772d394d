"""Stock level, turnover, idle stock and location reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.functions import measures as M
from stocklens.functions.classes import (
    stock_state4,
    turnover_class_annual,
    turnover_class_months,
)
from stocklens.operators.aggregates import amount, value_counts
from stocklens.operators.joins import join_dims, location_left_join
from stocklens.operators.ordering import asc, desc, top_first
from stocklens.operators.select import active, critical, slow_moving
from stocklens.sources.tables import Tables


def urgent_reorder(t: Tables) -> DataFrame:
    """R2: critical products with what to buy and from whom."""
    return (
        join_dims(critical(active(t.products)), t.categories, t.suppliers)
        .transform(M.with_days_of_stock)
        .transform(M.with_reorder_qty)
        .select(
            "product_id", "name", "category", "stock", "min_stock", "reorder_point",
            "sales_month", "supplier", "lead_days", "days_of_stock", "reorder_qty", "investment",
        )
        .orderBy(F.col("stock") != 0, desc("sales_month"), asc("product_id"))
    )


def critical_products(t: Tables) -> DataFrame:
    """Critical products with their state."""
    return (
        join_dims(critical(active(t.products)), t.categories, t.suppliers, how="left")
        .select(
            "product_id", "name", "category", "stock", "min_stock", "sales_month", "supplier",
            stock_state4().alias("stock_state"),
        )
        .orderBy(asc("stock"), desc("sales_month"), asc("product_id"))
    )


def inventory_turnover(t: Tables) -> DataFrame:
    """Months of stock and yearly turns with their class."""
    out = (
        join_dims(active(t.products), t.categories)
        .transform(M.with_annual_turnover)
        .select(
            "product_id", "name", "category", "stock", "sales_month", "unit_cost",
            F.round(M.months_of_stock(need_stock=True), 2).alias("months_of_stock"),
            "turnover_year",
            M.stock_value().alias("stock_value"),
            turnover_class_annual(F.col("turnover_year")).alias("turnover_class"),
        )
    )
    return top_first(out, "turnover_year")


def slow_movers(t: Tables, as_of: str) -> DataFrame:
    """Candidates for clearance, most money tied up first."""
    out = (
        join_dims(slow_moving(t.products, as_of), t.categories)
        .transform(M.with_idle, as_of)
        .select(
            "product_id", "name", "category", "stock", "sales_month", "sales_quarter",
            "last_sale", "idle_days", "tied_up_value", "clearance_price",
        )
    )
    return top_first(out, "tied_up_value")


def location_utilization(t: Tables) -> DataFrame:
    """Products, units and occupancy per location, empty ones included."""
    occupancy = F.round(M.percent(F.col("units"), F.col("capacity")), 2)
    out = (
        location_left_join(t.locations, t.products)
        .transform(M.with_location_code)
        .select(
            "location_id", "location_code", "capacity",
            F.coalesce("products", F.lit(0)).alias("products"),
            "units", occupancy.alias("occupancy_pct"), "value", "description",
        )
    )
    return top_first(out, "occupancy_pct", unique="location_id")


# Reports on a selection of the analysis frame --------------------------------


def critical_list(df: DataFrame) -> DataFrame:
    """Critical products of the selection, emptiest first."""
    return (
        critical(df)
        .withColumn("days_of_stock", M.days_of_stock_text())
        .select(
            "product_id", "name", "category", "stock", "min_stock", "sales_month", "supplier",
            "stock_state", "days_of_stock",
        )
        .orderBy(asc("stock"), asc("product_id"))
    )


def critical_summary(df: DataFrame) -> DataFrame:
    """Products per critical state and the value at risk."""
    empty, low = L.STATE_ICON[:2]
    return critical(df).agg(
        F.count_if(F.col("stock_state") == empty).alias("out_of_stock"),
        F.count_if(F.col("stock_state") == low).alias("critical"),
        F.coalesce(amount("stock_value"), F.lit(0).cast(M.AMOUNT)).alias("value_at_risk"),
    )


def purchase_recommendations(df: DataFrame) -> DataFrame:
    """What to buy to bring critical products to the reorder point."""
    out = critical(df).transform(M.with_reorder_qty).select(
        "product_id", "name", "supplier", "reorder_qty", "unit_cost", "investment"
    )
    return top_first(out, "investment")


def purchase_total(df: DataFrame) -> DataFrame:
    """Money needed for all recommendations."""
    total = amount(M.reorder_investment())
    return critical(df).agg(F.coalesce(total, F.lit(0).cast(M.AMOUNT)).alias("investment"))


def full_inventory_report(df: DataFrame) -> DataFrame:
    """The whole selection, most valuable stock first."""
    out = df.select(
        "product_id", "name", "category", "stock", "min_stock", "price", "unit_cost",
        "margin_pct", "sales_month", "stock_value", "stock_state", "supplier",
    )
    return top_first(out, "stock_value")


def turnover_report(df: DataFrame) -> DataFrame:
    """Months of stock of sold products, slowest first."""
    out = (
        df.filter(F.col("sales_month") > 0)
        .transform(M.with_months_of_stock, no_sales=L.NO_SALES_MONTHS)
        .select(
            "product_id", "name", "sales_month", "stock", "months_of_stock",
            turnover_class_months(F.col("months_of_stock")).alias("turnover_class"),
            "stock_value",
        )
    )
    return top_first(out, "months_of_stock")


def _barely_moving(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sales_month") <= 2).withColumn("tied_up_value", M.stock_value())


def no_movement_report(df: DataFrame) -> DataFrame:
    """Products with hardly any sales, most money tied up first."""
    out = _barely_moving(df).select(
        "product_id", "name", "category", "stock", "sales_month", "sales_quarter",
        "tied_up_value", "last_sale",
    )
    return top_first(out, "tied_up_value")


def no_movement_total(df: DataFrame) -> DataFrame:
    """Money tied up in them."""
    total = amount("tied_up_value")
    return _barely_moving(df).agg(
        F.coalesce(total, F.lit(0).cast(M.AMOUNT)).alias("tied_up_value")
    )


def stock_state_distribution(df: DataFrame) -> DataFrame:
    """Products per stock state."""
    return value_counts(df, "stock_state")


def selection_totals(df: DataFrame) -> DataFrame:
    """Stock value and active products of the selection."""
    return df.agg(
        amount("stock_value").alias("stock_value"),
        F.count_if("active").alias("active_products"),
    )
