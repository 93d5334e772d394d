import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stocklens.sources.readers import conform  # noqa: E402
from stocklens.sources.tables import Tables  # noqa: E402

AS_OF = "2024-03-01"
NOW = "2024-03-01 00:00:00"

# product_id, category_id, supplier_id, location_id, stock, sales_month, sales_prev_month,
# sales_quarter, sales_year, unit_cost, price, last_sale, active
PRODUCTS = [
    (1, 1, 1, 1, 0, 10, 8, 26, 100, "10.00", "20.00", "2024-02-28", True),
    (2, 1, 1, 1, 5, 0, 4, 6, 60, "5.00", "8.00", "2024-01-16", True),
    (3, 1, 2, 1, 10, 4, 0, 4, 24, "2.50", "4.00", "2024-01-15", True),
    (4, 2, 2, 2, 11, 0, 0, 0, 0, "7.00", "7.00", "2023-12-01", True),
    (5, 2, 2, 2, 3, 5, 2, 12, 40, "1.00", "0.00", "2024-02-01", True),
    (6, 2, 3, 2, 2, 10, 8, 30, 120, "3.00", "5.00", "2024-01-01", True),
    (7, 2, 1, 2, 30, 20, 20, 60, 240, "1.00", "2.50", "2023-12-31", True),
    (8, 9, 1, 2, 31, 20, 10, 40, 160, "1.00", "2.50", None, True),
    (9, None, None, None, 50, 1, 1, 3, 8, "4.00", "9.00", "2024-02-20", True),
    (10, 1, 1, 1, 40, 99, 1, 100, 100, "4.00", "9.00", "2024-02-20", False),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    rows = [
        (p, f"item {p}", c, s, loc, stock, m0, m1, q, y, Decimal(cost), Decimal(price), last, act)
        for p, c, s, loc, stock, m0, m1, q, y, cost, price, last, act in PRODUCTS
    ]
    products = spark.createDataFrame(
        rows,
        "product_id long, name string, category_id int, supplier_id long, location_id int, "
        "stock int, sales_month int, sales_prev_month int, sales_quarter int, sales_year int, "
        "unit_cost decimal(10,2), price decimal(10,2), last_sale string, active boolean",
    )
    categories = spark.createDataFrame(
        [(1, "tools"), (2, "paint")], "category_id int, category string"
    )
    suppliers = spark.createDataFrame(
        [(1, "north", 3, True), (2, "south", 9, False), (3, "east", 5, True), (4, "idle", 1, True)],
        "supplier_id long, supplier string, lead_days int, active boolean",
    )
    locations = spark.createDataFrame(
        [(1, "A", "1", "X", "1", 50), (2, "A", "2", None, "1", 60), (3, "B", "1", "X", None, 70)],
        "location_id int, section string, aisle string, shelf string, level string, capacity int",
    )
    movements = spark.createDataFrame(
        [
            (1, 1, "ENTRADA", 20, "2024-01-01", 5, 25),
            (2, 1, "SALIDA", 6, "2024-01-02", 25, 19),
            (3, 1, "AJUSTE", -4, "2024-01-03", 19, 15),
            (4, 1, "MERMA", 5, "2024-01-04", 15, 10),
            (5, 2, "SALIDA", 1, "2024-01-01", 6, 5),
            (6, 3, "ENTRADA", 3, "2024-01-05", 7, 11),
            (7, 3, "SALIDA", 1, "2024-01-06", 10, 9),
        ],
        "movement_id long, product_id long, kind string, quantity int, moved_at string, "
        "stock_before int, stock_after int",
    )
    alerts = spark.createDataFrame(
        [
            (1, 1, "STOCK_BAJO", "m1", "ACTIVA", "2024-01-01"),
            (2, 2, "STOCK_BAJO", "m2", "RESUELTA", "2024-01-02"),
            (3, 3, "STOCK_BAJO", "m3", "ACTIVA", "2024-01-03"),
        ],
        "alert_id long, product_id long, kind string, message string, status string, "
        "raised_at string",
    )
    frames = {
        "products": products, "categories": categories, "suppliers": suppliers,
        "locations": locations, "movements": movements, "alerts": alerts,
    }
    return Tables(**{n: conform(df, n, NOW).cache() for n, df in frames.items()})


def by_id(df, *columns, key="product_id"):
    """Key -> value, or tuple of values, of a small frame."""
    picked = df.select(key, *columns).collect()
    return {r[0]: r[1] if len(columns) == 1 else tuple(r[1:]) for r in picked}
