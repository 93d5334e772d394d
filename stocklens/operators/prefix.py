"""Ranks, row numbers, running totals and quantiles over a whole table.

A window without a partition runs in one task. Here the rows are cut into
bounded cells (see ``cells``), each cell is windowed on its own, and the row
count and sum of all earlier cells are added. The cell totals are a bounded
table. Results equal the plain window, ties included.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from stocklens.operators.cells import (
    CODE,
    ROWS_PER_CELL,
    SUB,
    Cuts,
    measure_cuts,
    sort_key,
)

_KEY, _TIE = "_key", "_tie"
_BEFORE_CELL, _BEFORE_CODE, _SUM_BEFORE = "_before_cell", "_before_code", "_sum_before"


def _order(df: DataFrame, order: str, unique: str | None, descending: bool):
    key = sort_key(F.col(order), df.schema[order].dataType, descending)
    return key, None if unique is None else F.col(unique).cast("bigint")


def distributed_prefix(
    df: DataFrame,
    order: str,
    unique: str | None = None,
    *,
    descending: bool = True,
    rank: str | None = None,
    row_number: str | None = None,
    running: tuple[str, str] | None = None,
    totals: Mapping[str, Column] | None = None,
    rows_per_cell: int = ROWS_PER_CELL,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Add global ``rank``, ``row_number`` and/or ``running`` columns.

    ``order`` is a number, date or timestamp column; ``unique`` a whole-number
    column that breaks its ties. It may be left out when ``order`` itself has
    no ties. ``running`` is (value column, output column); the sum covers all
    rows up to and including the row. NULL order keys come first. ``totals``
    are aggregates over all rows, taken in the pass that measures the cuts and
    added to every row. ``cuts`` that are already measured save that pass.
    """
    if totals and cuts is not None:
        raise ValueError("totals are taken while cuts are measured; give one of them")
    if running and isinstance(df.schema[running[0]].dataType, (DoubleType, FloatType)):
        raise ValueError("running sums need whole numbers or decimals, which add up in any order")
    key, tie = _order(df, order, unique, descending)
    if cuts is None:
        extra = [c.alias(n) for n, c in (totals or {}).items()]
        (cuts,), values = measure_cuts(df, [(key, tie)], rows_per_cell, extra)
        df = df.withColumns({n: F.lit(v) for n, v in zip(totals or {}, values)})
    by = {_KEY: key} if tie is None else {_KEY: key, _TIE: tie}
    keyed = df.withColumns(by)
    if cuts.single:
        # The whole set is one bounded cell: nothing comes before it.
        cells, offsets = keyed, None
        in_cell = Window.partitionBy(F.lit(0))
        before_cell, before_code, sum_before = F.lit(0), F.lit(0), F.lit(0)
    else:
        cells = cuts.assign(keyed, _KEY, None if tie is None else _TIE)
        offsets = _cell_offsets(cells, running)
        in_cell = Window.partitionBy(CODE, SUB)
        before_cell, before_code, sum_before = (
            F.col(_BEFORE_CELL), F.col(_BEFORE_CODE), F.col(_SUM_BEFORE)
        )

    ordered = in_cell.orderBy(*by)
    local: dict[str, Column] = {}
    final: dict[str, Column] = {}
    if rank:
        local[rank] = F.rank().over(in_cell.orderBy(_KEY))
        final[rank] = (F.col(rank) + before_code).cast("bigint")
    if row_number:
        local[row_number] = F.row_number().over(ordered)
        final[row_number] = (F.col(row_number) + before_cell).cast("bigint")
    if running:
        value, out = running
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local[out] = F.sum(value).over(upto)
        final[out] = F.col(out) + sum_before

    result = cells.withColumns(local)
    if offsets is not None:
        # The window left the rows partitioned by these same two columns.
        result = result.join(offsets, [CODE, SUB])
    helpers = [_KEY, _TIE, CODE, SUB, _BEFORE_CELL, _BEFORE_CODE, _SUM_BEFORE]
    return result.withColumns(final).drop(*helpers)


def global_ranks(
    df: DataFrame, ranks: Mapping[str, str], unique: str = "product_id",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Competition ranks by several columns, output name -> order column.

    The cuts of all orders come from one pass over the frame.
    """
    orders = [_order(df, column, unique, True) for column in ranks.values()]
    measured, _ = measure_cuts(df, orders, rows_per_cell)
    for (out, column), cuts in zip(ranks.items(), measured):
        df = distributed_prefix(df, column, unique, rank=out, cuts=cuts)
    return df


def _cell_offsets(cells: DataFrame, running: tuple[str, str] | None) -> DataFrame:
    """Rows and sum before each cell; one row per cell, a bounded number."""
    aggregates = [F.count("*").alias("_n")]
    if running:
        aggregates.append(F.sum(running[0]).alias("_s"))
    totals = cells.groupBy(CODE, SUB).agg(*aggregates)
    earlier = Window.orderBy(CODE, SUB).rowsBetween(Window.unboundedPreceding, -1)
    lower_codes = Window.orderBy(CODE).rangeBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    out = {
        _BEFORE_CELL: F.coalesce(F.sum("_n").over(earlier), zero),
        _BEFORE_CODE: F.coalesce(F.sum("_n").over(lower_codes), zero),
    }
    if running:
        out[_SUM_BEFORE] = F.coalesce(F.sum("_s").over(earlier), zero)
    return totals.select(CODE, SUB, *[c.alias(n) for n, c in out.items()])


def global_rank(df: DataFrame, col: str, out: str = "rank", unique: str = "product_id",
                **options) -> DataFrame:
    """Competition rank, largest first."""
    return distributed_prefix(df, col, unique, rank=out, **options)


def global_row_number(df: DataFrame, col: str, out: str = "row_number",
                      unique: str | None = "product_id", **options) -> DataFrame:
    """Position, largest first, ties by the unique column."""
    return distributed_prefix(df, col, unique, row_number=out, **options)


def running_total(df: DataFrame, order: str, value: str, out: str = "running",
                  unique: str | None = "product_id", **options) -> DataFrame:
    """Sum of all rows up to this one, largest first."""
    return distributed_prefix(df, order, unique, running=(value, out), **options)


def with_totals(df: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Aggregates over the whole frame on every row, by one scalar subquery."""
    row = df.agg(F.struct(*[c.alias(n) for n, c in totals.items()]).alias("_totals")).scalar()
    with_row = df.withColumn("_totals", row)
    return with_row.withColumns({n: F.col(f"_totals.{n}") for n in totals}).drop("_totals")


def quantiles(
    df: DataFrame,
    col: str,
    probabilities: Sequence[float],
    rows_per_cell: int = ROWS_PER_CELL,
) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours.

    The rows are counted per value, the counts are summed in value order, and
    the rows at the wanted positions are picked.
    """
    values = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    rows = values.agg(F.sum("_n")).first()[0]
    if not rows:
        return [None] * len(probabilities)
    positions = [p * (rows - 1) for p in probabilities]
    wanted = sorted({int(p) for p in positions} | {min(int(p) + 1, rows - 1) for p in positions})
    summed = distributed_prefix(
        values, col, descending=False, running=("_n", "_upto"), rows_per_cell=rows_per_cell
    )
    first = F.col("_upto") - F.col("_n")
    picked = summed.agg(*[
        F.max(F.when((first <= w) & (F.lit(w) < F.col("_upto")), F.col(col))).alias(str(w))
        for w in wanted
    ]).first()
    at = {w: float(picked[str(w)]) for w in wanted}
    return [
        at[int(p)] + (at[min(int(p) + 1, rows - 1)] - at[int(p)]) * (p - int(p))
        for p in positions
    ]


def quintile_label(df: DataFrame, score: str, labels: Sequence[str], out: str,
                   rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Label by fifth of the score, lowest first; intervals closed on the right."""
    n = len(labels)
    edges = quantiles(df, score, [i / n for i in range(1, n)], rows_per_cell)
    label = F.lit(labels[-1])
    for edge, name in reversed(list(zip(edges, labels))):
        label = F.when(F.col(score) <= F.lit(edge), name).otherwise(label)
    return df.withColumn(out, label)


def dense_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """0-based position of the value among the sorted distinct values; -1 for NULL."""
    values = df.select(F.col(col).alias("_value")).filter("_value IS NOT NULL").distinct()
    codes = distributed_prefix(values, "_value", descending=False, row_number="_code_number")
    joined = df.join(codes, F.col(col) == F.col("_value"), "left")
    code = F.coalesce(F.col("_code_number") - 1, F.lit(-1)).cast("int")
    return joined.withColumn(out, code).drop("_value", "_code_number")
