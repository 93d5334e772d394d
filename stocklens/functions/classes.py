"""Classifications of a product row; in each, the first rule that holds wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocklens.functions import labels as L


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    (condition, label), *rest = rules
    out = F.when(condition, F.lit(label))
    for condition, label in rest:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def position_in(col: Column, order: Sequence[str]) -> Column:
    """Rank of a label in a list, for sorting; unknown labels come last."""
    (first, *rest) = order
    out = F.when(col == first, 1)
    for i, label in enumerate(rest, start=2):
        out = out.when(col == label, i)
    return out.otherwise(len(order) + 1)


def stock_state4(labels: Sequence[str] = L.STATE_PLAIN) -> Column:
    """K1: none, at or below the minimum, at or below the reorder point, rest."""
    empty, critical, low, normal = labels
    return first_match([
        (F.col("stock") == 0, empty),
        (F.col("stock") <= F.col("min_stock"), critical),
        (F.col("stock") <= F.col("reorder_point"), low),
    ], normal)


def stock_state3(labels: Sequence[str] = L.STATE3_ICON) -> Column:
    """K2: as K1, an empty stock counting as critical."""
    critical, low, normal = labels
    return first_match([
        (F.col("stock") <= F.col("min_stock"), critical),
        (F.col("stock") <= F.col("reorder_point"), low),
    ], normal)


def turnover_class_annual(turns: Column) -> Column:
    """K3, by stock turns per year."""
    rules = [(turns >= limit, label) for limit, label in L.TURNOVER_YEAR]
    return first_match([*rules, (turns > 0, L.TURNOVER_YEAR_SLOW)], L.TURNOVER_YEAR_NONE)


def turnover_class_months(months: Column) -> Column:
    """K4, by months of stock."""
    rules = [(months < limit, label) for limit, label in L.TURNOVER_MONTHS]
    return first_match(rules, L.TURNOVER_MONTHS_SLOW)


def _season(index: int) -> Column:
    # sales > 1.5 * year / 12, in whole numbers so that equality is exact.
    scaled = F.col("sales_month").cast("bigint") * 24
    year = F.col("sales_year").cast("bigint")
    return first_match([
        (scaled > year * 3, L.SEASON_PEAK[index]),
        (scaled < year, L.SEASON_VALLEY[index]),
    ], L.SEASON_NORMAL[index])


def season_class() -> Column:
    """K5: the month against the mean month of the year."""
    return _season(0)


def season_advice() -> Column:
    return _season(1)


def _coverage(stock: Column, demand: Column, labels: Sequence[str]) -> Column:
    short, tight, enough = labels
    return first_match([(stock < demand, short), (stock * 2 < demand * 3, tight)], enough)


def future_stock_risk(projection: Column) -> Column:
    """K6: stock against the projected sales, with a margin of one half."""
    return _coverage(F.col("stock"), projection, L.FUTURE_STOCK)


def stockout_risk(forecast: Column) -> Column:
    """K7: the same limits on the model forecast."""
    return _coverage(F.col("stock"), forecast, L.STOCKOUT)


def abc_class(
    cumulative_pct: Column,
    a: float = L.ABC_LIMITS[0],
    b: float = L.ABC_LIMITS[1],
    labels: Sequence[str] = L.ABC_FULL,
) -> Column:
    """K8, by the cumulative share of revenue."""
    vital, important, normal = labels
    return first_match([(cumulative_pct <= a, vital), (cumulative_pct <= b, important)], normal)


def reorder_priority() -> Column:
    """K9: none left, at most half the minimum (rounded up at .5), rest."""
    critical, high, medium, _ = L.PRIORITIES
    half = F.floor((F.col("min_stock") + 1) / 2)
    return first_match(
        [(F.col("stock") == 0, critical), (F.col("stock") <= half, high)], medium
    )


def idle_priority(days: Column) -> Column:
    """K10, by days without a sale."""
    _, high, medium, low = L.PRIORITIES
    return first_match([(days > 90, high), (days > 60, medium)], low)


def anomaly_kind(is_anomaly: Column) -> Column:
    """What is unusual about an anomalous product."""
    sales, prev = F.col("sales_month"), F.col("sales_prev_month")
    return first_match([
        (~is_anomaly, L.ANOMALY_NONE),
        (sales > prev * 3, L.ANOMALY_PEAK),
        ((prev > 0) & (sales * 10 < prev * 3), L.ANOMALY_DROP),
        (F.col("stock") > sales * 6, L.ANOMALY_OVERSTOCK),
    ], L.ANOMALY_OTHER)


def cluster_name(
    sales: Column,
    margin: Column,
    turnover: Column,
    sales_high: Column,
    margin_good: Column,
    margin_high: Column,
    turnover_low: Column,
) -> Column:
    """Name of a cluster from its means and the overall quantiles."""
    return first_match([
        ((sales > sales_high) & (margin > margin_good), L.CLUSTER_STARS),
        (sales > sales_high, L.CLUSTER_VOLUME),
        (margin > margin_high, L.CLUSTER_PREMIUM),
        (turnover < turnover_low, L.CLUSTER_SLOW),
    ], L.CLUSTER_STANDARD)
