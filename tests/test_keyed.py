import random

import pytest

from stocklens.operators.keyed import lag_by_key, running_by_key, split_hot_keys


def ledger(n=400, seed=4):
    """(key, time, id, value) where key 0 holds half and times repeat."""
    rng = random.Random(seed)
    return [
        (0 if rng.random() < 0.5 else rng.randrange(1, 6), rng.randrange(20), i, rng.randrange(9))
        for i in range(n)
    ]


@pytest.mark.parametrize("hot_rows", [3, 25, 100_000])
def test_lag_and_running_sum(spark, hot_rows):
    rows = ledger()
    df = spark.createDataFrame(rows, "k int, t int, i long, v int").repartition(3)
    last, total, want = {}, {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] = total.get(k, 0) + v
        want[i] = (last.get(k), total[k])
        last[k] = v
    lagged = lag_by_key(df, "k", ["t", "i"], "v", "old", hot_rows)
    summed = running_by_key(df, "k", ["t", "i"], "v", "sum", hot_rows)
    assert {r.i: r.old for r in lagged.collect()} == {i: w[0] for i, w in want.items()}
    assert {r.i: r.sum for r in summed.collect()} == {i: w[1] for i, w in want.items()}
    assert set(lagged.columns) == {"k", "t", "i", "v", "old"}


def test_only_hot_keys_are_split(spark):
    df = spark.createDataFrame(ledger(), "k int, t int, i long, v int")
    cells, any_hot = split_hot_keys(df, "k", ["t", "i"], hot_rows=60)
    assert any_hot
    per_key = {r.k: r["count"] for r in cells.select("k", "_cell").distinct().groupBy("k").count().collect()}
    assert per_key[0] > 2 and all(per_key[k] == 1 for k in range(1, 6))


def test_one_time_for_all_rows_is_still_split(spark):
    df = spark.createDataFrame([(1, 5, i, 1) for i in range(200)], "k int, t int, i long, v int")
    cells, _ = split_hot_keys(df, "k", ["t", "i"], hot_rows=20)
    largest = cells.groupBy("_cell").count().agg({"count": "max"}).first()[0]
    assert largest <= 40
    summed = running_by_key(df, "k", ["t", "i"], "v", "sum", hot_rows=20)
    assert sorted(r.sum for r in summed.collect()) == list(range(1, 201))
