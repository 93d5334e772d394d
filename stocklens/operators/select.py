"""Row selections over products and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.operators.ordering import top_first


def active(df: DataFrame, include_inactive: bool = False) -> DataFrame:
    """active products only, unless all are asked for."""
    return df if include_inactive else df.filter(F.col("active"))


def select_inventory(
    df: DataFrame,
    category: str | None = None,
    supplier: str | None = None,
    states: Sequence[str] = (),
) -> DataFrame:
    """optional category, supplier and stock-state filters on an enriched frame."""
    if category not in (None, L.ALL_CATEGORIES):
        df = df.filter(F.col("category") == category)
    if supplier not in (None, L.ALL_SUPPLIERS):
        df = df.filter(F.col("supplier") == supplier)
    if states:
        df = df.filter(F.col("stock_state").isin(*states))
    return df


def facets(df: DataFrame, col: str) -> DataFrame:
    """the values a filter can take."""
    return df.select(col).na.drop().distinct().orderBy(col)


def is_critical() -> Column:
    return F.col("stock") <= F.col("min_stock")


def critical(df: DataFrame) -> DataFrame:
    """at or below the minimum."""
    return df.filter(is_critical())


def _before(as_of: str, days: int) -> Column:
    return F.col("last_sale") < F.date_sub(F.lit(as_of).cast("date"), days)


def slow_moving(df: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """more than a few units in stock, and few or only old sales."""
    seldom = (F.col("sales_month") <= 2) | _before(as_of, days)
    return active(df).filter(seldom & (F.col("stock") > 5))


def idle(df: DataFrame, as_of: str, days: int = 45) -> DataFrame:
    """in stock and not sold lately; never sold is not idle."""
    return active(df).filter(_before(as_of, days) & (F.col("stock") > 0))


def notable_forecasts(df: DataFrame) -> DataFrame:
    """sold products that need stock or change by more than a tenth."""
    notable = (F.col("suggested_purchase") > 0) | (F.abs("growth_pct") > 10)
    return df.filter((F.col("sales_month") > 0) & notable)


def active_alerts(alerts: DataFrame) -> DataFrame:
    """F8: open alerts, newest first."""
    open_ = alerts.filter(F.col("status") == L.STATUS_ACTIVE)
    return top_first(open_, "raised_at", unique="alert_id")
