"""Exact quantiles by selection against sorting."""

import random

import numpy as np
import pytest

from stocklens.operators import prefix, selection

PROBABILITIES = [0, 0.001, 0.2, 0.3, 1 / 3, 0.5, 0.8, 0.999, 1]


def expected(values, probabilities=PROBABILITIES):
    return [float(x) for x in np.quantile([v for v in values if v is not None], probabilities)]


def cases():
    rng = random.Random(4)
    yield "spread", [rng.gauss(0, 1000) for _ in range(30_000)]
    yield "a third the same", [7.0 if rng.random() < 0.34 else rng.uniform(0, 14) for _ in range(30_000)]
    yield "few values", [float(rng.randrange(3)) for _ in range(5000)]
    yield "one value", [2.5] * 1000
    yield "nulls", [None if rng.random() < 0.5 else rng.random() for _ in range(9000)]
    yield "tails", [10.0 ** rng.randrange(-300, 300) for _ in range(4000)] + [0.0, -0.0, -1e300]
    yield "two rows", [1.0, 4.0]
    yield "one row", [3.0]


@pytest.mark.parametrize("fetched", [0, 100, selection.FETCHED])
@pytest.mark.parametrize("name,values", list(cases()), ids=lambda x: x if isinstance(x, str) else "")
def test_equals_sorting(spark, monkeypatch, name, values, fetched):
    """``fetched`` of 0 narrows until the ends of the brackets are the values themselves."""
    if fetched == 0 and len(values) > 5000:
        pytest.skip("many scans")
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    found = selection.exact_quantiles(df, {"v": PROBABILITIES}, fetched=fetched)
    assert found["v"] == pytest.approx(expected(values), rel=1e-12)


def test_equals_the_ordered_path(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(500), None if i % 5 == 0 else rng.randrange(10**6)) for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, b int").selectExpr("a", "cast(b / 100 AS decimal(12,2)) AS b")
    found = selection.exact_quantiles(df, {"a": PROBABILITIES, "b": [0.3]})
    assert found == {"a": prefix.quantiles(df, "a", PROBABILITIES), "b": prefix.quantiles(df, "b", [0.3])}


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    low, middle, high = selection.exact_quantiles(df, {"v": [0, 0.5, 1]})["v"]
    assert (low, middle) == (1.0, 2.0) and high != high


def test_no_rows(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert selection.exact_quantiles(df, {"v": [0.5]}) == {"v": [None]}
    assert selection.exact_quantiles(df.limit(0), {"v": [0.5]}) == {"v": [None]}


def test_two_scans_suffice(spark, monkeypatch):
    scans = []
    for name in ("_narrow", "_fetch"):
        real = getattr(selection, name)
        monkeypatch.setattr(selection, name, lambda *a, real=real, n=name: (scans.append(n), real(*a))[1])
    df = spark.range(200_000).selectExpr("cast(hash(id) as double) as v")
    selection.exact_quantiles(df, {"v": [0.25, 0.9]})
    assert scans == ["_narrow", "_fetch"]
