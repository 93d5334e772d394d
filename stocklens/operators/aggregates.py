"""Aggregates shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions import measures as M
from stocklens.operators.select import is_critical


def total(col: Column | str) -> Column:
    """Sum of whole numbers as a 64-bit integer."""
    return F.sum(col).cast("bigint")


def amount(col: Column | str) -> Column:
    """Exact sum of money."""
    return F.sum(col).cast(M.AMOUNT)


def mean(col: Column | str, digits: int | None = 2, half_even: bool = False) -> Column:
    avg = F.avg(col)
    return avg if digits is None else M.rounded(avg, digits, half_even)


def critical_count() -> Column:
    return F.count_if(is_critical())


def mean_margin() -> Column:
    """Mean of the unrounded margins, rounded at the end."""
    return mean(M.margin_pct())


def value_counts(df: DataFrame, col: str, out: str = "products") -> DataFrame:
    """A4: rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count("*").alias(out)).orderBy(F.col(out).desc(), col)
