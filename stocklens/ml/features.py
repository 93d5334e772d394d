"""M1: model features of a product row."""

from __future__ import annotations

import datetime
import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.functions import measures as M
from stocklens.operators.prefix import dense_codes

LABEL = "sales_month"

# All demand features, and those that do not contain the label.
DEMAND_FEATURES = (
    "sales_month", "sales_prev_month", "sales_quarter", "stock", "price_ratio", "margin_abs",
    "turnover_year", "trend", "stock_sales_ratio", "category_code", "supplier_code",
    "days_since_sale", "seasonality",
)
FROM_LABEL = ("sales_month", "turnover_year", "trend", "stock_sales_ratio")
DEFAULT_FEATURES = tuple(f for f in DEMAND_FEATURES if f not in FROM_LABEL)
ANOMALY_FEATURES = (
    "sales_month", "sales_prev_month", "sales_quarter", "turnover_year", "trend",
    "stock_sales_ratio",
)
CLUSTER_FEATURES = (
    "sales_month", "turnover_year", "margin_abs", "price_ratio", "trend", "stock_sales_ratio",
)


def build_features(df: DataFrame, as_of: str, codes: bool = True) -> DataFrame:
    """Add the features; ``codes=False`` leaves out the category and supplier codes."""
    month = datetime.date.fromisoformat(as_of).month
    out = df.withColumns({
        "price_ratio": M.ratio(F.col("price"), F.col("unit_cost")),
        "margin_abs": M.unit_profit().cast("double"),
        "turnover_year": M.turnover_year(digits=None),
        "trend": M.growth(),
        "stock_sales_ratio": M.months_of_stock(no_sales=L.NO_SALES_MONTHS),
        "days_since_sale": M.idle_days(as_of),
        "seasonality": F.lit(math.sin(2 * math.pi * month / 12)),
    })
    if codes:
        out = dense_codes(out, "category_id", "category_code")
        out = dense_codes(out, "supplier_id", "supplier_code")
    return out


def assembled(df: DataFrame, features: tuple[str, ...], out: str = "features") -> DataFrame:
    """The features as one vector column, missing ones as 0."""
    zeroed = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    vectors = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol=out)
    return vectors.transform(zeroed).drop(*[f"_f_{c}" for c in features])
