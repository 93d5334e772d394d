import pytest
from pyspark.sql import functions as F

from conftest import by_id
from stocklens.functions import classes as C
from stocklens.functions import labels as L


def frame(spark, **columns):
    """Rows from equally long lists."""
    names = list(columns)
    rows = [(i, *values) for i, values in enumerate(zip(*columns.values()))]
    return spark.createDataFrame(rows, ["product_id", *names])


def labels(df, column):
    return [v for _, v in sorted(by_id(df.withColumn("label", column), "label").items())]


def test_stock_states(spark):
    df = frame(spark, stock=[0, 5, 6, 10, 11], min_stock=[5] * 5, reorder_point=[10] * 5)
    assert labels(df, C.stock_state4()) == ["SIN_STOCK", "CRITICO", "BAJO", "BAJO", "NORMAL"]
    critical, low, normal = L.STATE3_ICON
    assert labels(df, C.stock_state3()) == [critical, critical, low, low, normal]


def test_turnover_classes(spark):
    df = frame(spark, x=[12.0, 11.99, 6.0, 3.0, 2.99, 0.0])
    names = [label for _, label in L.TURNOVER_YEAR]
    assert labels(df, C.turnover_class_annual(F.col("x"))) == [
        names[0], names[1], names[1], names[2], L.TURNOVER_YEAR_SLOW, L.TURNOVER_YEAR_NONE
    ]
    months = frame(spark, x=[0.99, 1.0, 2.0, 3.0])
    fast = [label for _, label in L.TURNOVER_MONTHS]
    assert labels(months, C.turnover_class_months(F.col("x"))) == [
        fast[0], fast[1], fast[2], L.TURNOVER_MONTHS_SLOW
    ]


def test_season_limits_are_exclusive(spark):
    # A year of 24: a mean month is 2, the limits are 3 and 1.
    df = frame(spark, sales_month=[4, 3, 2, 1, 0], sales_year=[24] * 5)
    assert labels(df, C.season_class()) == [
        "PICO_ALTA", "NORMAL", "NORMAL", "NORMAL", "VALLE_BAJA"
    ]
    assert labels(df, C.season_advice())[0] == L.SEASON_PEAK[1]


def test_coverage_limits(spark):
    df = frame(spark, stock=[9, 10, 14, 15], need=[10] * 4)
    risk, tight, enough = L.FUTURE_STOCK
    assert labels(df, C.future_stock_risk(F.col("need"))) == [risk, tight, tight, enough]
    assert labels(df, C.stockout_risk(F.col("need"))) == ["ALTO", "MEDIO", "MEDIO", "BAJO"]


def test_abc_limits(spark):
    df = frame(spark, pct=[80.0, 80.004, 95.0, 95.1])
    a, b, c = L.ABC_FULL
    assert labels(df, C.abc_class(F.col("pct"))) == [a, b, b, c]
    assert labels(df, C.abc_class(F.round("pct", 2))) == [a, a, b, c]


@pytest.mark.parametrize("minimum,stocks,expected", [
    (5, [0, 1, 3, 4, 5], ["CRÍTICA", "ALTA", "ALTA", "MEDIA", "MEDIA"]),
    (4, [0, 2, 3], ["CRÍTICA", "ALTA", "MEDIA"]),
])
def test_reorder_priority(spark, minimum, stocks, expected):
    df = frame(spark, stock=stocks, min_stock=[minimum] * len(stocks))
    assert labels(df, C.reorder_priority()) == expected


def test_idle_priority(spark):
    df = frame(spark, d=[91, 90, 61, 60])
    assert labels(df, C.idle_priority(F.col("d"))) == ["ALTA", "MEDIA", "MEDIA", "BAJA"]


def test_anomaly_kind(spark):
    df = frame(
        spark,
        odd=[False, True, True, True, True, True],
        sales_month=[9, 31, 2, 3, 0, 10],
        sales_prev_month=[1, 10, 10, 10, 0, 10],
        stock=[0, 0, 0, 19, 1, 60],
    )
    assert labels(df, C.anomaly_kind(F.col("odd"))) == [
        L.ANOMALY_NONE, L.ANOMALY_PEAK, L.ANOMALY_DROP, L.ANOMALY_OVERSTOCK,
        L.ANOMALY_OVERSTOCK, L.ANOMALY_OTHER,
    ]


def test_cluster_name(spark):
    df = frame(
        spark, s=[9.0, 9.0, 1.0, 1.0, 1.0], m=[60.0, 10.0, 90.0, 10.0, 10.0],
        t=[5.0, 5.0, 5.0, 0.5, 5.0],
    )
    name = C.cluster_name(
        F.col("s"), F.col("m"), F.col("t"), F.lit(8.0), F.lit(50.0), F.lit(80.0), F.lit(1.0)
    )
    assert labels(df, name) == [
        L.CLUSTER_STARS, L.CLUSTER_VOLUME, L.CLUSTER_PREMIUM, L.CLUSTER_SLOW, L.CLUSTER_STANDARD
    ]
