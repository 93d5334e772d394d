"""M6: isolation forest (Liu, Ting, Zhou 2008) over product features.

Trees are grown on samples of a few hundred rows, one task group per tree.
A tree is a handful of small arrays and the forest a bounded broadcast, so
scoring is one vectorised pass over the products.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.functions.classes import anomaly_kind
from stocklens.ml.features import ANOMALY_FEATURES, build_features
from stocklens.operators.ordering import asc
from stocklens.operators.prefix import quantiles, quintile_label
from stocklens.sources.scratch import materialized

TREES = 100
SAMPLE = 256
SEED = 42
# Rows left for a tree before sorting, in samples, and the range of their hashes.
SPARE, HASHES = 2, 2**40
EULER = 0.5772156649015329
TREE_SCHEMA = (
    "tree int, feature array<int>, threshold array<double>, "
    "left array<int>, right array<int>, path array<double>"
)


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + EULER
    long = 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow_tree(sample: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One isolation tree as node arrays; leaves hold their path length."""
    limit = int(np.ceil(np.log2(max(len(sample), 2))))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "path")}

    def add(rows: np.ndarray, depth: int) -> int:
        node = len(nodes["feature"])
        for column, blank in zip(nodes.values(), (-1, 0.0, -1, -1, 0.0)):
            column.append(blank)
        spread = rows.max(axis=0) > rows.min(axis=0)
        if depth >= limit or len(rows) <= 1 or not spread.any():
            nodes["path"][node] = depth + float(expected_path(len(rows)))
            return node
        feature = int(rng.choice(np.flatnonzero(spread)))
        values = rows[:, feature]
        cut = rng.uniform(values.min(), values.max())
        goes_left = values <= cut
        nodes["feature"][node], nodes["threshold"][node] = feature, float(cut)
        nodes["left"][node] = add(rows[goes_left], depth + 1)
        nodes["right"][node] = add(rows[~goes_left], depth + 1)
        return node

    add(sample, 0)
    return nodes


def _samples(
    df: DataFrame, columns: Sequence[str], rows: int, trees: int, size: int
) -> DataFrame:
    """``size`` rows for every tree: those with the smallest hashes of product and tree.

    Rows whose hash is far from small are left out before sorting; about
    ``SPARE * size`` rows per tree remain, or all of a small table.
    """
    slim = df.select("product_id", *columns)
    bound = min(HASHES, HASHES * SPARE * size // max(rows, 1) + 1)

    def drawn(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.col("product_id"), tree, F.lit(SEED)), F.lit(HASHES))

    every = F.sequence(F.lit(0), F.lit(trees - 1))
    dealt = slim.withColumn("tree", F.explode(F.filter(every, lambda t: drawn(t) < bound)))
    order = Window.partitionBy("tree").orderBy(drawn(F.col("tree")), "product_id")
    return dealt.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= size).drop("_n")


def fit_forest(
    df: DataFrame, columns: Sequence[str], rows: int, trees: int = TREES, size: int = SAMPLE
) -> list[dict]:
    """The trees; at most trees * 2 * size nodes reach the driver."""
    columns = list(columns)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        # Rows in a fixed order, so that the tree does not depend on the shuffle.
        sample = rows.sort_values("product_id")[columns].to_numpy(dtype=float)
        nodes = grow_tree(sample, np.random.default_rng([SEED, tree]))
        return pd.DataFrame([{"tree": tree, **nodes}])

    sampled = _samples(df, columns, rows, trees, size)
    grown = sampled.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)
    return [row.asDict() for row in grown.orderBy("tree").collect()]


def score_rows(rows: np.ndarray, forest: Sequence[dict], size: int) -> np.ndarray:
    """-2^(-mean path / expected path): the lower, the more anomalous."""
    total = np.zeros(len(rows))
    at_row = np.arange(len(rows))
    for tree in forest:
        feature, threshold = np.asarray(tree["feature"]), np.asarray(tree["threshold"])
        left, right = np.asarray(tree["left"]), np.asarray(tree["right"])
        node = np.zeros(len(rows), dtype=int)
        inner = feature[node] >= 0
        while inner.any():
            goes_left = rows[at_row, np.maximum(feature[node], 0)] <= threshold[node]
            node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
            inner = feature[node] >= 0
        total += np.asarray(tree["path"])[node]
    return -np.power(2.0, -(total / len(forest)) / float(expected_path(size)))


def with_scores(df: DataFrame, columns: Sequence[str], forest: list[dict], size: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(score_rows(rows.to_numpy(dtype=float), shared.value, size))

    return df.withColumn("score", score(F.struct(*columns)))


def _standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit deviation; a constant column becomes 0."""
    moments = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"dev_{c}") for c in columns],
    ).first()
    scaled = {}
    for c in columns:
        mean, deviation = moments[f"mean_{c}"] or 0.0, moments[f"dev_{c}"] or 1.0
        scaled[f"_z_{c}"] = (F.col(c) - F.lit(float(mean))) / F.lit(float(deviation))
    return df.withColumns(scaled)


def score_products(
    df: DataFrame, as_of: str, contamination: float = 0.1, trees: int = TREES, size: int = SAMPLE
) -> DataFrame:
    """Every product with score, flag, quintile label and kind."""
    columns = list(ANOMALY_FEATURES)
    features = build_features(df, as_of, codes=False).withColumns(
        {f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    ).select(
        "product_id", "name", "sales_month", "sales_prev_month", "stock",
        *[f"_f_{c}" for c in columns],
    )
    raw = [f"_f_{c}" for c in columns]
    # Read for moments, sampling and scoring.
    features = materialized(features, "anomaly-features")
    scaled = _standardised(features, raw)
    z = [f"_z_{c}" for c in raw]
    rows = features.count()
    sample = min(size, rows)
    forest = fit_forest(scaled, z, rows, trees, sample)
    scored = with_scores(scaled, z, forest, sample).drop(*raw, *z)
    # Read for the quantiles and the result; scoring is the dear step.
    scored = materialized(scored, "anomaly-scores")
    (limit,) = quantiles(scored, "score", [contamination])
    flagged = scored.withColumn("is_anomaly", F.col("score") < F.lit(limit))
    labelled = quintile_label(flagged, "score", L.ANOMALY_QUINTILES, "quintile")
    return labelled.withColumn("kind", anomaly_kind(F.col("is_anomaly")))


def detect_anomalies(df: DataFrame, as_of: str, contamination: float = 0.1, **options) -> DataFrame:
    """M6: the anomalous products, most anomalous first."""
    return (
        score_products(df, as_of, contamination, **options)
        .filter("is_anomaly")
        .select(
            "product_id", "name", "sales_month", "stock", "is_anomaly", "score", "quintile",
            "kind",
        )
        .orderBy("score", asc("product_id"))
    )
