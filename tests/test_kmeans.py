"""k-means from many starts against plain numpy and the engine's own."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from stocklens.ml import cluster, kmeans


def frame(spark, rows, parts=3):
    data = [(i, Vectors.dense(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ["id", "scaled"]).repartition(parts).cache()


def blobs(seed=1, groups=6, each=60):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 20, (groups, 3))
    return np.concatenate([m + rng.normal(0, 1, (each, 3)) for m in middle])


def cost(rows, centres):
    return ((rows[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_cheapest_start_is_as_cheap_as_the_engine_s(spark):
    rows = blobs()
    df = frame(spark, rows)
    fit = kmeans.fit_starts(df, "id", "scaled", 6, starts=10)
    assert len(fit.costs) == 10 and fit.cost == min(fit.costs)
    assert fit.cost == pytest.approx(cost(rows, fit.centres), rel=1e-9)
    engine = cluster.best_kmeans(df, 6, starts=10).summary.trainingCost
    assert fit.cost <= engine * (1 + 1e-6)


def test_a_fit_is_settled_and_does_not_depend_on_the_partitions(spark):
    rows = blobs(seed=3)
    one = kmeans.fit_starts(frame(spark, rows), "id", "scaled", 4, starts=4)
    two = kmeans.fit_starts(frame(spark, rows, 7), "id", "scaled", 4, starts=4)
    assert np.allclose(one.centres, two.centres) and one.rounds == two.rounds
    nearest = ((rows[:, None] - one.centres[None]) ** 2).sum(2).argmin(1)
    means = np.array([rows[nearest == c].mean(0) for c in range(4)])
    assert np.allclose(means, one.centres, atol=1e-3)
    got = {r.id: r.c for r in one.assign(frame(spark, rows), "scaled", "c").collect()}
    assert [got[i] for i in range(len(rows))] == nearest.tolist()


def test_passes_do_not_grow_with_the_starts(spark, monkeypatch):
    df, passes = frame(spark, blobs(seed=5)), []
    real = kmeans._totals
    monkeypatch.setattr(kmeans, "_totals", lambda *a: (passes.append(len(a[1])), real(*a))[1])
    fit = kmeans.fit_starts(df, "id", "scaled", 5, starts=10)
    assert len(passes) == kmeans.SEED_ROUNDS + 1 + fit.rounds + 1 and passes[0] == 10


@pytest.mark.parametrize("rows", [[[1.0, 2.0]], [[1.0, 1.0]] * 20, [[0.0, 0.0], [5.0, 5.0]]])
def test_fewer_different_rows_than_clusters(spark, rows):
    fit = kmeans.fit_starts(frame(spark, rows), "id", "scaled", 3, starts=2)
    assert fit.cost == 0 and len(fit.centres) == 3


def test_a_third_of_the_rows_alike(spark):
    rng = random.Random(2)
    rows = np.array([[7.0, 7.0] if i % 3 == 0 else [rng.uniform(0, 50), rng.uniform(0, 50)]
                     for i in range(300)])
    fit = kmeans.fit_starts(frame(spark, rows), "id", "scaled", 5, starts=6)
    engine = cluster.best_kmeans(frame(spark, rows), 5, starts=6).summary.trainingCost
    assert fit.cost <= engine * 1.02
