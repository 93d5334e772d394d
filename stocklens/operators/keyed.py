"""Previous value and running sum per key, safe for very large keys.

A window per key puts a whole key into one task. Keys above a row limit are
split along the order into cells (see ``cells``); each cell is windowed on
its own and the state at the end of the key's earlier cells is carried in.
Keys below the limit keep one cell each, and when the table is smaller than
the limit nothing is added to the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklens.operators.cells import CODE, MAX_CUTS, SUB, measure_cuts, sort_key

HOT_ROWS = 1_000_000
CELL = "_cell"
_ORDER, _TIE, _HOT = "_order", "_order_tie", "_hot"


def split_hot_keys(
    df: DataFrame, key: str, order: Sequence[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, bool]:
    """Add the cell column: 0 for ordinary keys, 1.. along the order for hot ones.

    Returns the frame and whether any key can be hot. The first order column
    cuts; where its values repeat a lot, the second (a whole number) does.
    """
    rows = df.count()
    if rows <= hot_rows:
        return df.withColumn(CELL, F.lit(0)), False
    keyed = df.withColumn(_ORDER, sort_key(F.col(order[0]), df.schema[order[0]].dataType))
    tie = None
    if len(order) > 1:
        keyed = keyed.withColumn(_TIE, F.col(order[1]).cast("bigint"))
        tie = _TIE
    columns = (F.col(_ORDER), None if tie is None else F.col(tie))
    (cuts,), _ = measure_cuts(keyed, [columns], hot_rows)
    # At most rows / hot_rows keys can exceed the limit.
    hot = (
        df.groupBy(F.col(key).alias(_HOT)).agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > hot_rows)
    ).select(_HOT)
    cells = cuts.assign(keyed, _ORDER, tie)
    number = (F.col(CODE) + 1) * (MAX_CUTS + 1) + F.col(SUB) + 1
    joined = cells.join(hot, F.col(key) == F.col(_HOT), "left")
    cell = F.when(F.col(_HOT).isNotNull(), number).otherwise(0)
    return joined.withColumn(CELL, cell).drop(_ORDER, _TIE, CODE, SUB, _HOT), True


def lag_by_key(
    df: DataFrame, key: str, order: Sequence[str], value: str, out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The value of the key's previous row; NULL on its first row."""
    cells, any_hot = split_hot_keys(df, key, order, hot_rows)
    window = Window.partitionBy(key, CELL).orderBy(*order)
    lagged = cells.withColumns(
        {out: F.lag(value).over(window), "_n": F.row_number().over(window)}
    )
    if not any_hot:
        return lagged.drop("_n", CELL)
    # A plain order column is hash-aggregated, a struct needs a sort.
    latest = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    ends = (
        cells.filter(F.col(CELL) > 0).groupBy(key, CELL).agg(F.max_by(value, latest).alias("_end"))
    )
    along = Window.partitionBy(key).orderBy(CELL)
    carried = ends.select(key, CELL, F.lag("_end").over(along).alias("_carried"))
    joined = lagged.join(carried, [key, CELL], "left")
    first = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col(out))
    return joined.withColumn(out, first).drop("_n", "_carried", CELL)


def running_by_key(
    df: DataFrame, key: str, order: Sequence[str], value: str, out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Sum of the key's rows up to and including this one."""
    cells, any_hot = split_hot_keys(df, key, order, hot_rows)
    window = (
        Window.partitionBy(key, CELL)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = cells.withColumn(out, F.sum(value).over(window))
    if not any_hot:
        return summed.drop(CELL)
    sums = (
        cells.filter(F.col(CELL) > 0).groupBy(key, CELL).agg(F.sum(value).alias("_sum"))
    )
    earlier = (
        Window.partitionBy(key).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = sums.select(key, CELL, F.sum("_sum").over(earlier).alias("_carried"))
    joined = summed.join(carried, [key, CELL], "left")
    total = F.col(out) + F.coalesce(F.col("_carried"), F.lit(0))
    return joined.withColumn(out, total).drop("_carried", CELL)
