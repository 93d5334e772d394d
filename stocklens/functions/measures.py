"""Derived measures of a product row.

Column functions read the product columns by name; the ``with_*`` transforms
add them to a frame. Money stays decimal and exact; ratios are doubles with
every divisor guarded. ``half_even`` selects banker's rounding, which the
selection-based reports use; the rest rounds halves away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions import labels as L

DOUBLE = "double"
AMOUNT = "decimal(18,2)"


def rounded(col: Column, digits: int, half_even: bool = False) -> Column:
    """Rounded halves away from zero, in decimal: 0.575 gives 0.58.

    ``half_even`` rounds the scaled binary value to the nearest even number,
    as array libraries do: 0.575 is a little less and gives 0.57.
    """
    if not half_even:
        return F.round(col, digits)
    scale = F.lit(10.0**digits)
    return F.rint(col * scale) / scale if digits else F.rint(col)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL where den is zero or NULL."""
    return F.try_divide(num.cast(DOUBLE), den.cast(DOUBLE))


def percent(num: Column, den: Column) -> Column:
    """100 * num / den with one inexact step, so that exact halves stay halves."""
    return ratio(num * 100, den)


def percent_of_ratio(num: Column, den: Column) -> Column:
    """The same through the ratio, for reports that take 100 times a ratio."""
    return ratio(num, den) * 100.0


# E1 ------------------------------------------------------------------------


def unit_profit() -> Column:
    return F.col("price") - F.col("unit_cost")


def margin_pct(half_even: bool = False) -> Column:
    """Profit as a percentage of the price, unrounded."""
    formula = percent_of_ratio if half_even else percent
    return formula(unit_profit(), F.col("price"))


def profit_month() -> Column:
    return (unit_profit() * F.col("sales_month")).cast(AMOUNT)


def stock_value() -> Column:
    return (F.col("stock") * F.col("unit_cost")).cast(AMOUNT)


def with_margin(df: DataFrame, half_even: bool = False) -> DataFrame:
    return df.withColumns({
        "unit_profit": unit_profit().cast(AMOUNT),
        "margin_pct": rounded(margin_pct(half_even), 2, half_even),
        "profit_month": profit_month(),
        "stock_value": stock_value(),
    })


# E2 ------------------------------------------------------------------------


def revenue(sales: str = "sales_month") -> Column:
    return (F.col(sales) * F.col("price")).cast(AMOUNT)


def cost_month() -> Column:
    return (F.col("sales_month") * F.col("unit_cost")).cast(AMOUNT)


def with_revenue(df: DataFrame) -> DataFrame:
    return df.withColumns({"revenue_month": revenue(), "cost_month": cost_month()})


# E3-E6 ---------------------------------------------------------------------


def turnover_month() -> Column:
    return F.when(
        F.col("stock") > 0, ratio(F.col("sales_month"), F.col("stock"))
    ).otherwise(0.0)


def with_turnover(df: DataFrame) -> DataFrame:
    return df.withColumn("turnover_month", turnover_month())


def months_of_stock(no_sales: float | None = None, need_stock: bool = False) -> Column:
    """Stock / sales; ``no_sales`` where nothing was sold.

    With ``need_stock`` an empty stock counts as unknown too.
    """
    sold = F.col("sales_month") > 0
    if need_stock:
        sold = sold & (F.col("stock") > 0)
    fallback = F.lit(no_sales).cast(DOUBLE)
    return F.when(sold, ratio(F.col("stock"), F.col("sales_month"))).otherwise(fallback)


def with_months_of_stock(
    df: DataFrame, no_sales: float | None = None, need_stock: bool = False
) -> DataFrame:
    return df.withColumn("months_of_stock", months_of_stock(no_sales, need_stock))


def turnover_year(digits: int | None = 2) -> Column:
    """Stock turns per year, 0 without stock or sales."""
    turns = ratio(F.lit(12) * F.col("sales_month"), F.col("stock"))
    if digits is not None:
        turns = F.round(turns, digits)
    moving = (F.col("stock") > 0) & (F.col("sales_month") > 0)
    return F.when(moving, turns).otherwise(0.0)


def with_annual_turnover(df: DataFrame, digits: int | None = 2) -> DataFrame:
    return df.withColumn("turnover_year", turnover_year(digits))


def days_of_stock(half_even: bool = False) -> Column:
    """Days until the stock is sold at the current rate; NULL without sales."""
    if half_even:
        return rounded(ratio(F.col("stock"), F.col("sales_month")) * 30.0, 1, half_even=True)
    return F.round(ratio(F.col("stock") * 30, F.col("sales_month")), 1)


def days_of_stock_text() -> Column:
    """The same as text for display, with a label where nothing was sold."""
    days = F.format_string("%.1f", days_of_stock(half_even=True))
    return F.when(F.col("sales_month") > 0, days).otherwise(L.NO_SALES)


def with_days_of_stock(df: DataFrame, half_even: bool = False) -> DataFrame:
    return df.withColumn("days_of_stock", days_of_stock(half_even))


# E7-E8 ---------------------------------------------------------------------


def growth() -> Column:
    """Change against the previous month as a fraction; 0 without a base."""
    change = F.col("sales_month") - F.col("sales_prev_month")
    return F.when(
        F.col("sales_prev_month") > 0, ratio(change, F.col("sales_prev_month"))
    ).otherwise(0.0)


def growth_pct(digits: int | None = None) -> Column:
    """Growth in percent, unrounded or rounded in decimal."""
    if digits is None:
        return growth() * 100.0
    change = F.col("sales_month") - F.col("sales_prev_month")
    pct = F.round(percent(change, F.col("sales_prev_month")), digits)
    return F.when(F.col("sales_prev_month") > 0, pct).otherwise(0.0)


def with_growth(df: DataFrame, digits: int | None = None) -> DataFrame:
    return df.withColumn("growth_pct", growth_pct(digits))


def projection(half_even: bool = False) -> Column:
    """Next month's sales if the growth goes on, as whole units.

    sales * (1 + (sales - prev) / prev) is sales^2 / prev; that form has one
    rounding in doubles, so exact halves stay exact.
    """
    sales = F.col("sales_month").cast(DOUBLE)
    trend = rounded(ratio(sales * sales, F.col("sales_prev_month")), 0, half_even)
    return (
        F.when(F.col("sales_prev_month") > 0, trend).otherwise(sales).cast("bigint")
    )


def with_projection(df: DataFrame, half_even: bool = False) -> DataFrame:
    return df.withColumn("projection", projection(half_even))


# E9-E13 --------------------------------------------------------------------


def reorder_qty() -> Column:
    return F.col("reorder_point") - F.col("stock")


def reorder_investment() -> Column:
    return (reorder_qty() * F.col("unit_cost")).cast(AMOUNT)


def with_reorder_qty(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"reorder_qty": reorder_qty(), "investment": reorder_investment()}
    )


def suggested_purchase() -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.col("projection") - F.col("stock"))


def with_suggested_purchase(df: DataFrame) -> DataFrame:
    return df.withColumn("suggested_purchase", suggested_purchase())


def idle_days(as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), F.col("last_sale"))


def clearance_price() -> Column:
    return F.round(F.col("price") * F.lit("0.7").cast("decimal(2,1)"), 2).cast(AMOUNT)


def with_idle(df: DataFrame, as_of: str) -> DataFrame:
    return df.withColumns({
        "idle_days": idle_days(as_of),
        "tied_up_value": stock_value(),
        "clearance_price": clearance_price(),
    })


def with_averages(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "avg_quarter": F.round(F.col("sales_quarter").cast(DOUBLE) / 3.0, 2),
        "avg_year": F.round(F.col("sales_year").cast(DOUBLE) / 12.0, 2),
    })


def location_code(parts: tuple[str, ...] = ("section", "aisle", "shelf", "level")) -> Column:
    """Parts joined by ``-``.

    All four parts: a missing part is left empty, its separators stay. Fewer
    parts: any missing part makes the code NULL.
    """
    cols = [F.col(p) for p in parts]
    if len(parts) == 4:
        cols = [F.coalesce(c, F.lit("")) for c in cols]
    pieces: list[Column] = []
    for c in cols:
        pieces += [F.lit("-"), c] if pieces else [c]
    return F.concat(*pieces)


def with_location_code(
    df: DataFrame, parts: tuple[str, ...] = ("section", "aisle", "shelf", "level")
) -> DataFrame:
    return df.withColumn("location_code", location_code(parts))
