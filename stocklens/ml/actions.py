"""Actions and opportunities drawn from the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.ml.anomaly import detect_anomalies
from stocklens.ml.cluster import cluster_products
from stocklens.ml.forecast import forecast_demand


def critical_actions(forecast: DataFrame) -> DataFrame:
    """M9: urgent purchases for products at high risk."""
    action, priority, _ = L.URGENT_PURCHASE
    return forecast.filter(F.col("risk") == L.STOCKOUT[0]).select(
        "product_id", "name", "stock", "forecast", "suggested_purchase",
        F.lit(action).alias("action"), F.lit(priority).alias("priority"),
    )


def opportunities(clusters: DataFrame) -> DataFrame:
    """One row per star, slow or premium cluster."""
    per_cluster = clusters.groupBy("cluster").agg(
        F.first("cluster_name").alias("cluster_name"), F.count("*").alias("products")
    )
    known = [
        F.when(F.col("cluster_name") == name, F.struct(
            F.lit(kind).alias("kind"),
            F.lit(text % name).alias("description"),
            F.lit(action).alias("action"),
        ))
        for name, (kind, text, action) in L.OPPORTUNITIES.items()
    ]
    return (
        per_cluster.withColumn("o", F.coalesce(*known))
        .filter(F.col("o").isNotNull())
        .select("cluster", "o.kind", "o.description", "products", "o.action")
        .orderBy("cluster")
    )


def recommendations(df: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Everything the models say about an enriched frame."""
    forecast = forecast_demand(df, as_of)
    clusters = cluster_products(df, as_of)
    return {
        "forecast": forecast.rows,
        "forecast_metrics": forecast.metrics,
        "anomalies": detect_anomalies(df, as_of),
        "clusters": clusters.rows,
        "cluster_stats": clusters.stats,
        "critical_actions": critical_actions(forecast.rows),
        "opportunities": opportunities(clusters.rows),
    }
