"""Orders and top-k with NULL placement and ties spelled out.

Spark and the databases these reports come from place NULLs differently:
descending columns here put them first and ascending ones last unless a
report says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def desc(col: str | Column, nulls_last: bool = False) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.desc_nulls_last() if nulls_last else col.desc_nulls_first()


def asc(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.asc_nulls_last()


def top_first(df: DataFrame, *cols: str, unique: str = "product_id",
              nulls_last: bool = False) -> DataFrame:
    """Largest first, ties by the unique column."""
    return df.orderBy(*[desc(c, nulls_last) for c in cols], asc(unique))


def top_k(df: DataFrame, k: int, col: str | Column, unique: str = "product_id") -> DataFrame:
    """O3: the k largest; each task keeps k rows, nothing is sorted whole."""
    return df.orderBy(desc(col), asc(unique)).limit(k)
