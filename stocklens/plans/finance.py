"""Profitability, supplier, ABC and margin reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.functions import measures as M
from stocklens.functions.classes import abc_class
from stocklens.operators.aggregates import (
    amount,
    critical_count,
    mean,
    mean_margin,
    total,
    value_counts,
)
from stocklens.operators.joins import category_dim, join_dims, supplier_dim
from stocklens.operators.ordering import asc, desc, top_first, top_k
from stocklens.operators.prefix import distributed_prefix, with_totals
from stocklens.operators.select import active
from stocklens.sources.tables import Tables


def category_profitability(t: Tables) -> DataFrame:
    """Stock, margin, profit and revenue per category.

    Aggregated per key first, so that the join sees one row per category.
    """
    sums = active(t.products).groupBy("category_id").agg(
        F.count("*").alias("products"),
        total("stock").alias("stock"),
        mean_margin().alias("mean_margin_pct"),
        amount(M.stock_value()).alias("stock_value"),
        amount(M.profit_month()).alias("profit_month"),
        amount(M.revenue()).alias("revenue_month"),
        total("sales_month").alias("units_month"),
    )
    names = category_dim(t.categories).select("category_id", "category")
    out = sums.join(names, "category_id").select("category_id", "category", *sums.columns[1:])
    return top_first(out, "profit_month", unique="category_id")


def category_profitability_brief(t: Tables) -> DataFrame:
    """R3 without the units column."""
    return category_profitability(t).drop("units_month")


def top15_profitable(t: Tables, k: int = 15) -> DataFrame:
    """Most profitable products of the month."""
    sold = active(t.products).filter(F.col("sales_month") > 0)
    rows = (
        join_dims(sold, t.categories)
        .transform(M.with_margin)
        .transform(M.with_revenue)
        .select(
            "product_id", "name", "category", "unit_cost", "price", "unit_profit", "margin_pct",
            "sales_month", "profit_month", "revenue_month",
        )
    )
    return top_k(rows, k, "profit_month")


def supplier_performance(t: Tables) -> DataFrame:
    """Range, stock, revenue, margin and critical products per supplier."""
    sums = active(t.products).groupBy("supplier_id").agg(
        F.count("product_id").alias("products"),
        total("stock").alias("stock"),
        amount(M.stock_value()).alias("stock_value"),
        amount(M.revenue()).alias("revenue_month"),
        mean_margin().alias("mean_margin_pct"),
        critical_count().alias("critical_products"),
    )
    names = supplier_dim(t.suppliers).select(
        "supplier_id", "supplier", "supplier_rating", "lead_days"
    )
    out = names.join(sums, "supplier_id")
    return top_first(out, "revenue_month", unique="supplier_id")


def category_supplier_efficiency(t: Tables) -> DataFrame:
    """Sales, margin, capital and critical share per category and supplier."""
    keys = ["category", "supplier", "supplier_rating", "lead_days"]
    critical_pct = F.round(M.percent(critical_count(), F.count("*")), 2)
    return (
        join_dims(active(t.products), t.categories, t.suppliers)
        .groupBy(*keys)
        .agg(
            F.count("product_id").alias("products"),
            mean("sales_month").alias("mean_sales"),
            mean_margin().alias("mean_margin_pct"),
            amount(M.stock_value()).alias("tied_up_value"),
            critical_count().alias("critical_products"),
            critical_pct.alias("critical_pct"),
        )
        .orderBy(desc("mean_margin_pct"), asc("critical_pct"), "category", "supplier")
    )


def _accumulated(rows: DataFrame, **prefix_options) -> DataFrame:
    """Rank, running revenue and revenue total of products with sales."""
    return distributed_prefix(
        rows, "revenue_month", "product_id",
        row_number="rank", running=("revenue_month", "cumulative_revenue"),
        totals={"_total": F.sum("revenue_month")}, **prefix_options,
    )


def abc_analysis(t: Tables, **prefix_options) -> DataFrame:
    """Rank, cumulative share and class by revenue; the class uses the rounded share."""
    sold = active(t.products).filter(F.col("sales_month") > 0)
    rows = join_dims(sold, t.categories).select(
        "product_id", "name", "category", M.revenue().alias("revenue_month")
    )
    share = M.percent(F.col("cumulative_revenue"), F.col("_total"))
    return (
        _accumulated(rows, **prefix_options)
        .withColumn("cumulative_pct", F.round(share, 2))
        .select(
            "product_id", "name", "category", "rank", "revenue_month", "cumulative_pct",
            abc_class(F.col("cumulative_pct")).alias("abc_class"),
        )
        .orderBy("rank")
    )


# Reports on a selection of the analysis frame --------------------------------


def abc_table(df: DataFrame, **prefix_options) -> DataFrame:
    """ABC classes within the selection, by the unrounded share."""
    sold = df.filter(F.col("sales_month") > 0).withColumn("revenue_month", M.revenue())
    share = M.percent_of_ratio(F.col("cumulative_revenue"), F.col("_total"))
    out = _accumulated(sold, **prefix_options).withColumn("cumulative_pct", share)
    label = abc_class(F.col("cumulative_pct"), labels=L.ABC_SELECTION)
    return out.withColumn("abc_class", label).drop("_total")


def abc_filtered(df: DataFrame, **prefix_options) -> DataFrame:
    """The classified products, best first."""
    slim = df.select("product_id", "name", "price", "sales_month", "margin_pct")
    return abc_table(slim, **prefix_options).select(
        "product_id", "name", "rank", "revenue_month", "cumulative_revenue",
        "cumulative_pct", "abc_class",
    ).orderBy("rank")


def abc_class_counts(df: DataFrame, **prefix_options) -> DataFrame:
    """Products per class."""
    slim = df.select("product_id", "price", "sales_month")
    return value_counts(abc_table(slim, **prefix_options), "abc_class")


def abc_top_a(df: DataFrame, k: int = 10, **prefix_options) -> DataFrame:
    """The best products of class A."""
    slim = df.select("product_id", "name", "price", "sales_month", "margin_pct")
    best = abc_table(slim, **prefix_options).filter(F.col("abc_class") == L.ABC_SELECTION[0])
    return best.orderBy("rank").limit(k).select(
        "product_id", "name", "revenue_month", "margin_pct"
    )


def revenue_share(df: DataFrame) -> DataFrame:
    """Revenue of each sold product with the totals of the whole selection."""
    sold = df.filter(F.col("sales_month") > 0).select(
        "product_id", M.revenue().alias("revenue_month")
    )
    return with_totals(sold, {
        "total_revenue": amount("revenue_month"), "total_products": F.count("*"),
    })


def financial_kpis(df: DataFrame) -> DataFrame:
    """Revenue, cost, profit and net margin of the selection."""
    sums = df.agg(
        amount(M.revenue()).alias("revenue_month"), amount(M.cost_month()).alias("cost_month")
    )
    profit = (F.col("revenue_month") - F.col("cost_month")).cast(M.AMOUNT)
    return sums.withColumn("profit_month", profit).withColumn("net_margin_pct", net_margin())


def net_margin() -> Column:
    """Profit share of the revenue in percent; 0 without revenue."""
    share = M.percent_of_ratio(F.col("profit_month"), F.col("revenue_month"))
    return F.when(F.col("revenue_month") > 0, share).otherwise(0.0)


def _summary(df: DataFrame, key: str) -> DataFrame:
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        total("sales_month").alias("units_month"),
        amount("profit_month").alias("profit_month"),
        amount("stock_value").alias("stock_value"),
        F.count("product_id").alias("products"),
        mean("margin_pct", half_even=True).alias("mean_margin_pct"),
    )
    return top_first(out, "profit_month", unique=key)


def category_summary(df: DataFrame) -> DataFrame:
    """Units, profit, value, products and mean margin per category."""
    return _summary(df, "category")


def supplier_summary(df: DataFrame) -> DataFrame:
    """The same per supplier."""
    return _summary(df, "supplier")


def margin_report(df: DataFrame) -> DataFrame:
    """The selection by margin."""
    out = df.select(
        "product_id", "name", "unit_cost", "price", "unit_profit", "margin_pct", "sales_month",
        "profit_month",
    )
    return top_first(out, "margin_pct")


def exact_mean_margin() -> Column:
    """Mean of the rounded margins; summed as decimals, so order plays no part."""
    hundredths = F.col("margin_pct").cast("decimal(18,2)")
    return M.ratio(F.sum(hundredths), F.count("margin_pct"))


def margin_stats(df: DataFrame) -> DataFrame:
    """Mean, largest and smallest margin."""
    return df.agg(
        exact_mean_margin().alias("mean_margin_pct"),
        F.max("margin_pct").alias("max_margin_pct"),
        F.min("margin_pct").alias("min_margin_pct"),
    )
