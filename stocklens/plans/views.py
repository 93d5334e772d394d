"""The three standing views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions import measures as M
from stocklens.functions.classes import stock_state4
from stocklens.operators.joins import join_dims
from stocklens.operators.ordering import asc, desc, top_first
from stocklens.operators.prefix import global_ranks
from stocklens.operators.select import active
from stocklens.sources.sinks import register_views
from stocklens.sources.tables import Tables


def critical_stock(t: Tables) -> DataFrame:
    """V1: stock state of every active product, emptiest first."""
    return (
        join_dims(active(t.products), t.categories, t.suppliers, how="left")
        .select(
            "product_id", "name", "category", "stock", "min_stock", "reorder_point",
            "supplier", "lead_days", "sales_month", stock_state4().alias("stock_state"),
        )
        .orderBy(asc("stock"), desc("sales_month"), asc("product_id"))
    )


def profitability(t: Tables) -> DataFrame:
    """V2: margin, profit, stock value and months of stock per active product."""
    out = join_dims(active(t.products), t.categories, how="left").transform(M.with_margin)
    out = out.select(
        "product_id", "name", "category", "unit_cost", "price", "unit_profit", "margin_pct",
        "sales_month", "profit_month", "stock_value",
        F.round(M.months_of_stock(), 2).alias("months_of_stock"),
    )
    return top_first(out, "profit_month", nulls_last=True)


def top_products(t: Tables, **prefix_options) -> DataFrame:
    """V3: products with sales, ranked by units and by profit."""
    sold = active(t.products).filter(F.col("sales_month") > 0)
    base = join_dims(sold, t.categories, how="left").select(
        "product_id", "name", "category", "sales_month", "sales_quarter", "sales_year",
        M.profit_month().alias("profit_month"), "stock",
    )
    ranks = {"rank_sales": "sales_month", "rank_profit": "profit_month"}
    return top_first(global_ranks(base, ranks, **prefix_options), "sales_month")


# Names under which SQL users know the views.
VIEWS = {
    "vista_stock_critico": critical_stock,
    "vista_rentabilidad": profitability,
    "vista_top_productos": top_products,
}


def register(t: Tables) -> list[str]:
    """Publish the views for SQL."""
    spark = t.products.sparkSession
    return register_views(spark, {name: view(t) for name, view in VIEWS.items()})
