"""Demand forecast, its metrics and what-if scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.functions.classes import position_in, stockout_risk
from stocklens.ml.features import DEFAULT_FEATURES, LABEL, assembled, build_features
from stocklens.operators.ordering import asc
from stocklens.sources.scratch import materialized

MIN_HISTORY = 10
SEED = 42
METRICS = "mae double, rmse double, products bigint, confidence double"


@dataclass(frozen=True)
class Forecast:
    """Forecast rows, one row of metrics, and the model if one was fitted."""

    rows: DataFrame
    metrics: DataFrame
    model: RandomForestRegressionModel | None
    features: tuple[str, ...]


def in_training(train_share: int = 80):
    """A fixed pseudo-random share of products, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.col("product_id"), F.lit(SEED)), F.lit(100)) < train_share


def _with_actions(df: DataFrame) -> DataFrame:
    """M4: risk and purchase with a fifth as buffer."""
    short = (F.col("forecast") * 12 - F.col("stock") * 10).cast("double") / 10.0
    return df.withColumns({
        "risk": stockout_risk(F.col("forecast")),
        "suggested_purchase": F.rint(F.greatest(F.lit(0.0), short)).cast("bigint"),
    })


def simple_forecast(df: DataFrame, horizon_days: int = 30) -> DataFrame:
    """M5: mean of two months, for when there is too little history for a model."""
    months = horizon_days / 30
    both = (F.col("sales_month") + F.col("sales_prev_month")).cast("double") / 2.0 * months
    only = F.col("sales_month").cast("double") * months
    expected = F.rint(F.when(F.col("sales_prev_month") > 0, both).otherwise(only))
    out = df.select(
        "product_id", "name", "sales_month", "stock", expected.cast("bigint").alias("forecast")
    )
    return out.withColumns({
        "confidence": F.lit(50.0),
        "risk": F.lit(L.STOCKOUT[1]),
        "suggested_purchase": F.greatest(
            F.lit(0).cast("bigint"), F.col("forecast") - F.col("stock")
        ),
    })


def forecast_demand(
    df: DataFrame,
    as_of: str,
    horizon_days: int = 30,
    feature_cols: Sequence[str] = DEFAULT_FEATURES,
    label_col: str = LABEL,
    trees: int = 100,
    depth: int = 10,
) -> Forecast:
    """M2: random forest on products with sales in the quarter.

    The default features leave out the label and what is computed from it;
    pass ``DEMAND_FEATURES`` to use everything.
    """
    features = tuple(feature_cols)
    spark = df.sparkSession
    history = df.filter(F.col("sales_quarter") > 0)
    if len(history.select("product_id").take(MIN_HISTORY)) < MIN_HISTORY:
        rows = simple_forecast(df, horizon_days)
        metrics = spark.createDataFrame([(0.0, 0.0, df.count(), 50.0)], METRICS)
        return Forecast(rows, metrics, None, features)

    vectors = assembled(build_features(history, as_of), features).select(
        "product_id", "name", "sales_month", "stock",
        F.col(label_col).cast("double").alias("label"), "features",
        in_training().alias("training"),
    )
    # Read by every level of every tree.
    vectors = materialized(vectors, "demand-features")
    forest = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="all",
        maxMemoryInMB=1024,
    )
    model = forest.fit(vectors.filter("training"))
    predicted = model.transform(vectors)
    metrics = _metrics(predicted).first()

    rows = _with_actions(
        predicted.select(
            "product_id", "name", "sales_month", "stock",
            F.greatest(
                F.lit(0.0), F.rint(F.col("prediction") * (horizon_days / 30))
            ).cast("bigint").alias("forecast"),
            F.lit(metrics["confidence"]).alias("confidence"),
        )
    ).orderBy(position_in(F.col("risk"), L.STOCKOUT), asc("product_id"))
    return Forecast(rows, spark.createDataFrame([metrics], METRICS), model, features)


def _metrics(predicted: DataFrame) -> DataFrame:
    """M3: errors on the held-out part, and the confidence drawn from them."""
    error = F.when(~F.col("training"), F.col("prediction") - F.col("label"))
    sums = predicted.agg(
        F.coalesce(F.avg(F.abs(error)), F.lit(0.0)).alias("mae"),
        F.coalesce(F.sqrt(F.avg(error * error)), F.lit(0.0)).alias("rmse"),
        F.count("*").alias("products"),
        F.avg(F.when(F.col("training"), F.col("label"))).alias("typical"),
    )
    relative = F.coalesce(F.try_divide(F.col("mae"), F.col("typical")), F.lit(0.0))
    confidence = F.least(F.lit(100.0), F.lit(100.0) - relative * 100.0)
    return sums.select("mae", "rmse", "products", confidence.alias("confidence"))


def feature_importance(forecast: Forecast, spark) -> DataFrame:
    """Importance per feature, largest first; empty without a model."""
    pairs = []
    if forecast.model is not None:
        weights = forecast.model.featureImportances.toArray()
        pairs = [(n, float(w)) for n, w in zip(forecast.features, weights)]
    frame = spark.createDataFrame(pairs, "feature string, importance double")
    return frame.orderBy(F.col("importance").desc(), "feature")


def apply_scenario(df: DataFrame, demand_multiplier: float = 1.0, price_change: float = 0.0) -> DataFrame:
    return df.withColumns({
        "sales_month": F.col("sales_month") * F.lit(float(demand_multiplier)),
        "price": (F.col("price") * F.lit(f"{1 + price_change:.12f}").cast("decimal(18,12)")).cast("decimal(28,12)"),
    })


def simulate_scenarios(
    df: DataFrame, scenarios: Mapping[str, Mapping[str, float]], as_of: str, **options
) -> tuple[DataFrame, DataFrame]:
    """Forecast and metrics of every scenario, tagged by its name.

    One model per scenario: the loop is over scenarios, each fit is a
    distributed job.
    """
    rows, metrics = [], []
    for name, parameters in scenarios.items():
        result = forecast_demand(apply_scenario(df, **parameters), as_of, **options)
        tag = F.lit(name).alias("scenario")
        rows.append(result.rows.select(tag, "*"))
        metrics.append(result.metrics.select(tag, "*"))
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, metrics)
