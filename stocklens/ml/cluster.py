"""M7, M8: product clusters, their statistics and names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StandardScaler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions import measures as M
from stocklens.functions.classes import cluster_name
from stocklens.ml import kmeans
from stocklens.ml.features import CLUSTER_FEATURES, assembled, build_features
from stocklens.operators.aggregates import mean
from stocklens.operators.prefix import quantiles
from stocklens.sources.scratch import materialized

SEED = 42
STARTS = 10


@dataclass(frozen=True)
class Clusters:
    """Products with their cluster, and one row per cluster with means and name."""

    rows: DataFrame
    stats: DataFrame
    model: kmeans.Fit


def best_kmeans(vectors: DataFrame, k: int, starts: int = STARTS) -> KMeansModel:
    """The cheapest of several k-means fits of the engine's own, made one after the other."""
    fits = (
        KMeans(k=k, seed=SEED + i, featuresCol="scaled", maxIter=300).fit(vectors)
        for i in range(starts)
    )
    return min(fits, key=lambda model: model.summary.trainingCost)


def cluster_products(df: DataFrame, as_of: str, k: int = 5, starts: int = STARTS) -> Clusters:
    """M7: k-means on standardised features of an enriched frame, all starts in the same passes."""
    features = build_features(df, as_of, codes=False).withColumn(
        "margin_pct", M.rounded(M.margin_pct(half_even=True), 2, half_even=True)
    )
    vectors = assembled(features, CLUSTER_FEATURES).select(
        "product_id", "name", "category", "sales_month", "margin_pct", "turnover_year",
        F.col("price").cast("double").alias("price"), "features",
    )
    # Read by every iteration of every start.
    vectors = materialized(vectors, "cluster-features")
    scaler = StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(vectors)
    scaled = scaler.transform(vectors).drop("features").persist()
    model = kmeans.fit_starts(scaled, "product_id", "scaled", k, starts, SEED)
    scaled.unpersist()
    clustered = materialized(model.assign(scaled, "scaled", "cluster").drop("scaled"), "clusters")
    stats = cluster_stats(clustered)
    rows = clustered.join(stats.select("cluster", "cluster_name"), "cluster", "left").select(
        "product_id", "name", "category", "sales_month", "margin_pct", "cluster", "cluster_name"
    )
    return Clusters(rows, stats, model)


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """M8: rounded means per cluster, and the name they earn it."""
    (sales_high,) = quantiles(clustered, "sales_month", [0.8])
    margin_good, margin_high = quantiles(clustered, "margin_pct", [0.7, 0.8])
    (turnover_low,) = quantiles(clustered, "turnover_year", [0.3])
    means = clustered.groupBy("cluster").agg(
        mean("sales_month", half_even=True).alias("mean_sales"),
        mean("margin_pct", half_even=True).alias("mean_margin_pct"),
        mean("turnover_year", half_even=True).alias("mean_turnover"),
        mean("price", half_even=True).alias("mean_price"),
        F.count("*").alias("products"),
    )
    name = cluster_name(
        F.col("mean_sales"), F.col("mean_margin_pct"), F.col("mean_turnover"),
        F.lit(sales_high), F.lit(margin_good), F.lit(margin_high), F.lit(turnover_low),
    )
    return means.withColumn("cluster_name", name).orderBy("cluster")
