"""Sales, projection and season reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.functions import measures as M
from stocklens.functions.classes import (
    future_stock_risk,
    position_in,
    season_advice,
    season_class,
    stock_state3,
)
from stocklens.operators.aggregates import amount, total
from stocklens.operators.joins import join_dims
from stocklens.operators.ordering import asc, desc, top_first, top_k
from stocklens.operators.select import active, notable_forecasts
from stocklens.sources.tables import Tables


def _best_sellers(df: DataFrame, k: int, labels: Sequence[str], *names: str) -> DataFrame:
    rows = df.select(
        "product_id", "name", *names, "sales_month", "stock",
        M.profit_month().alias("profit_month"), stock_state3(labels).alias("stock_state"),
    )
    return top_k(rows, k, "sales_month")


def top10_sales(t: Tables, k: int = 10) -> DataFrame:
    """Best sellers with their supplier."""
    joined = join_dims(active(t.products), t.categories, t.suppliers)
    return _best_sellers(joined, k, L.STATE3_ICON, "category", "supplier")


def top15_sales(t: Tables, k: int = 15) -> DataFrame:
    """Best sellers by category."""
    return _best_sellers(
        join_dims(active(t.products), t.categories), k, L.STATE3_PLAIN, "category"
    )


def sales_projection(t: Tables) -> DataFrame:
    """Next month's sales and whether the stock covers them."""
    out = (
        join_dims(active(t.products), t.categories)
        .transform(M.with_growth, digits=2)
        .transform(M.with_projection)
        .transform(M.with_suggested_purchase)
        .select(
            "product_id", "name", "category", "sales_month", "sales_prev_month", "growth_pct",
            "projection", "stock", "reorder_point",
            future_stock_risk(F.col("projection")).alias("future_stock"),
            "suggested_purchase",
        )
    )
    return top_first(out, "growth_pct")


def monthly_comparison(t: Tables) -> DataFrame:
    """This month against the last, both at the current price."""
    sums = active(t.products).agg(
        total("sales_month").alias("units_month"),
        total("sales_prev_month").alias("units_prev_month"),
        amount(M.revenue()).alias("revenue_month"),
        amount(M.revenue("sales_prev_month")).alias("revenue_prev_month"),
    )

    def change(now: str, before: str):
        return F.round(M.percent(F.col(now) - F.col(before), F.col(before)), 2)

    return sums.select(
        F.lit(L.MONTHLY_TITLE).alias("period"),
        "*",
        change("units_month", "units_prev_month").alias("units_growth_pct"),
        change("revenue_month", "revenue_prev_month").alias("revenue_growth_pct"),
    )


def seasonal_patterns(t: Tables) -> DataFrame:
    """Season class and advice of products sold during the year."""
    sold = active(t.products).filter(F.col("sales_year") > 0)
    order = [s[0] for s in (L.SEASON_PEAK, L.SEASON_VALLEY)]
    return (
        join_dims(sold, t.categories)
        .transform(M.with_averages)
        .select(
            "product_id", "name", "category", "sales_month", "sales_prev_month",
            "sales_quarter", "sales_year", "avg_quarter", "avg_year",
            season_class().alias("season"), season_advice().alias("advice"),
        )
        .orderBy(
            position_in(F.col("season"), order), desc("sales_month"), asc("product_id")
        )
    )


# Reports on a selection of the analysis frame --------------------------------


def forecast_frame(df: DataFrame) -> DataFrame:
    """Trend forecast of every product of the selection."""
    return (
        df.transform(M.with_growth)
        .transform(M.with_projection, half_even=True)
        .transform(M.with_suggested_purchase)
        .withColumn("risk", future_stock_risk(F.col("projection")))
    )


def trend_forecast(df: DataFrame) -> DataFrame:
    """The notable forecasts, fastest growth first."""
    out = notable_forecasts(forecast_frame(df)).select(
        "product_id", "name", "sales_month", "sales_prev_month", "growth_pct", "projection",
        "stock", "risk", "suggested_purchase",
    )
    return top_first(out, "growth_pct")


def trend_forecast_kpis(df: DataFrame) -> DataFrame:
    """Products at risk, mean growth and units to buy."""
    return forecast_frame(df).agg(
        F.count_if(F.col("risk") == L.FUTURE_STOCK[0]).alias("at_risk"),
        F.avg("growth_pct").alias("mean_growth_pct"),
        F.coalesce(total("suggested_purchase"), F.lit(0)).alias("suggested_purchase"),
    )


def category_trend(df: DataFrame) -> DataFrame:
    """Units of both months and mean growth per category."""
    return (
        df.transform(M.with_growth)
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            total("sales_month").alias("units_month"),
            total("sales_prev_month").alias("units_prev_month"),
            F.avg("growth_pct").alias("mean_growth_pct"),
        )
        .orderBy("category")
    )


def top20_sales_report(df: DataFrame, k: int = 20) -> DataFrame:
    """Best sellers of the selection with turnover."""
    rows = df.select(
        "product_id", "name", "sales_month", "sales_prev_month", "profit_month", "stock",
        "turnover_month",
    )
    return top_k(rows, k, "sales_month")


def best_sellers(df: DataFrame, k: int = 10) -> DataFrame:
    """O3: the selection's top products by units, with their margin."""
    rows = df.select("product_id", "name", "sales_month", "margin_pct")
    return top_k(rows, k, "sales_month")
