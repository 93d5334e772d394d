"""Running stock from the movement ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.operators.keyed import (
    CELL,
    HOT_ROWS,
    lag_by_key,
    running_by_key,
    split_hot_keys,
)

ORDER = ("moved_at", "movement_id", "kind", "quantity")
_FIRST = -(2**63)


def signed_quantity() -> Column:
    """Effect on stock: in adds, out and loss take away, an adjustment has its own sign."""
    kind, quantity = F.col("kind"), F.col("quantity")
    return (
        F.when(kind.isin(L.KIND_IN, L.KIND_ADJUST), quantity)
        .when(kind.isin(L.KIND_OUT, L.KIND_LOSS), -quantity)
        .cast("bigint")
    )


def apply_movements(
    ledger: DataFrame, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The ledger with ``stock``, the level after each movement.

    A product starts from the ``stock_before`` of its first movement, or 0. In
    the window of an ordinary product that is the first value. For products
    that are split the opening level takes part as one more row at the front,
    which needs no join.
    """
    cells, any_hot = split_hot_keys(ledger, "product_id", list(order), hot_rows)
    if not any_hot:
        window = Window.partitionBy("product_id").orderBy(*order)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        opening = F.coalesce(F.first("stock_before").over(upto), F.lit(0)).cast("bigint")
        return cells.drop(CELL).withColumn(
            "stock", (opening + F.sum(signed_quantity()).over(upto)).cast("bigint"))
    rows = ledger.withColumns({"_signed": signed_quantity(), "_opening": F.lit(False)})
    slim = ledger.select("product_id", "stock_before", *order)
    opening = slim.groupBy("product_id").agg(
        F.coalesce(F.min_by("stock_before", F.struct(*order)), F.lit(0))
        .cast("bigint").alias("_signed")
    )
    # No time sorts before every time.
    opening = opening.withColumns(
        {"movement_id": F.lit(_FIRST).cast("bigint"), "_opening": F.lit(True)}
    )
    both = rows.unionByName(opening, allowMissingColumns=True)
    summed = running_by_key(both, "product_id", list(order), "_signed", "stock", hot_rows)
    return summed.filter(~F.col("_opening")).drop("_signed", "_opening")


def ledger_breaks(
    ledger: DataFrame, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Movements whose levels do not follow.

    ``wrong_sum``: the level after is not the level before plus the quantity.
    ``gap``: the level before is not the previous movement's level after.
    """
    lagged = lag_by_key(ledger, "product_id", list(order), "stock_after", "_previous", hot_rows)
    wrong = F.col("stock_after") != F.col("stock_before") + signed_quantity()
    gap = F.col("stock_before") != F.col("_previous")
    checked = lagged.withColumns({
        "wrong_sum": F.coalesce(wrong, F.lit(False)), "gap": F.coalesce(gap, F.lit(False)),
    })
    return checked.filter(F.col("wrong_sum") | F.col("gap")).drop("_previous")


def stock_on_hand(ledger: DataFrame) -> DataFrame:
    """Net quantity and movement count per product; batch, or stream in update mode."""
    return ledger.groupBy("product_id").agg(
        F.sum(signed_quantity()).cast("bigint").alias("net_quantity"),
        F.count("*").alias("movements"),
    )
