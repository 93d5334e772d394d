"""Key figures and the insights drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.functions import measures as M
from stocklens.operators.aggregates import amount, critical_count, mean_margin, total
from stocklens.operators.select import active
from stocklens.plans.finance import exact_mean_margin, net_margin
from stocklens.sources.tables import Tables


def executive_kpis(t: Tables) -> DataFrame:
    """One row over all active products."""
    return active(t.products).agg(
        F.count("*").alias("products"),
        F.count_if(F.col("stock") > 0).alias("in_stock"),
        critical_count().alias("critical_products"),
        amount(M.stock_value()).alias("stock_value"),
        amount(M.revenue()).alias("revenue_month"),
        amount(M.profit_month()).alias("profit_month"),
        mean_margin().alias("mean_margin_pct"),
        total("sales_month").alias("units_month"),
    ).withColumn("section", F.lit(L.SUMMARY_TITLE))


def mean_turnover() -> Column:
    """A5: mean over the products that turn at all; 0 if none does."""
    turning = F.when(F.col("turnover_month") > 0, F.col("turnover_month"))
    return F.coalesce(F.avg(turning), F.lit(0.0))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(M.percent_of_ratio(F.col(part), F.col(whole)), F.lit(0.0))


def _kpis(df: DataFrame, *extra: Column) -> DataFrame:
    zero = F.lit(0).cast(M.AMOUNT)
    sums = df.agg(
        F.count("*").alias("products"),
        F.count_if("active").alias("active_products"),
        critical_count().alias("critical_products"),
        F.coalesce(amount("stock_value"), zero).alias("stock_value"),
        F.coalesce(amount(M.revenue()), zero).alias("revenue_month"),
        F.coalesce(amount(M.cost_month()), zero).alias("cost_month"),
        exact_mean_margin().alias("mean_margin_pct"),
        mean_turnover().alias("mean_turnover"),
        F.count_if(F.col("sales_month") == 0).alias("no_sales_products"),
        *extra,
    )
    profit = (F.col("revenue_month") - F.col("cost_month")).cast(M.AMOUNT)
    return sums.withColumns({
        "profit_month": profit, "critical_pct": _share("critical_products", "products"),
    }).withColumn("net_margin_pct", net_margin())


def business_kpis(df: DataFrame) -> DataFrame:
    """Counts, values, margins and turnover of a selection."""
    return _kpis(df)


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """R20, the smaller set."""
    return _kpis(df).select(
        "products", "active_products", "critical_products", "stock_value", "revenue_month",
        "profit_month", "mean_margin_pct", "critical_pct",
    )


def _insight(condition: Column, insight: tuple[str, ...], value: Column | None = None) -> Column:
    kind, title, message, priority = insight
    text = F.lit(message) if value is None else F.format_string(message, value)
    return F.when(condition, F.struct(
        F.lit(kind).alias("kind"),
        F.lit(title).alias("title"),
        text.alias("message"),
        F.lit(priority).alias("priority"),
    ))


def insights(df: DataFrame) -> DataFrame:
    """The findings that hold for a selection, in the order of the rules.

    All figures come from one aggregation over the selection.
    """
    growing = F.count_if(F.col("growth_pct") > 50).alias("growing_products")
    k = _kpis(df, growing)

    def one_decimal(name: str) -> Column:
        return F.format_string("%.1f", F.col(name))

    margin = F.col("net_margin_pct")
    rules = F.array_compact(F.array(
        _insight(F.col("critical_pct") > 15, L.INSIGHT_CRITICAL, one_decimal("critical_pct")),
        _insight(margin < 20, L.INSIGHT_LOW_MARGIN, one_decimal("net_margin_pct")),
        _insight(margin > 35, L.INSIGHT_HIGH_MARGIN, one_decimal("net_margin_pct")),
        _insight(F.col("mean_turnover") < 0.5, L.INSIGHT_LOW_TURNOVER),
        _insight(
            F.col("no_sales_products") * 5 > F.col("products"),
            L.INSIGHT_NO_SALES,
            F.col("no_sales_products"),
        ),
        _insight(
            F.col("growing_products") > 0, L.INSIGHT_GROWTH, F.col("growing_products")
        ),
    ))
    found = k.select(F.posexplode(rules).alias("position", "insight"))
    return found.select("position", "insight.*").orderBy("position")
