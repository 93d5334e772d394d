"""Prefix operators against brute force, with skew, ties and NULLs."""

import datetime
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklens.operators import prefix
from stocklens.operators.cells import CODE, SUB, measure_cuts, sort_key


def skewed(n, seed=1):
    """Values of which a third are one and the same."""
    rng = random.Random(seed)
    return [(i, 7 if rng.random() < 0.34 else rng.randrange(n)) for i in range(n)]


def brute(rows):
    """id -> (rank, row number, running sum), largest first."""
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    out, running, rank = {}, 0, 0
    for position, (i, v) in enumerate(ordered, start=1):
        if position == 1 or v != ordered[position - 2][1]:
            rank = position
        running += v
        out[i] = (rank, position, running)
    return out


@pytest.mark.parametrize("rows_per_cell", [1, 7, 50, 100_000])
def test_equals_plain_window(spark, rows_per_cell):
    rows = skewed(500)
    df = spark.createDataFrame(rows, "product_id long, v int").repartition(5)
    out = prefix.distributed_prefix(
        df, "v", "product_id", rank="r", row_number="n", running=("v", "s"),
        rows_per_cell=rows_per_cell,
    )
    got = {x.product_id: (x.r, x.n, x.s) for x in out.collect()}
    assert got == brute(rows)
    assert out.columns == ["product_id", "v", "r", "n", "s"]


def test_no_cell_is_large_however_skewed(spark):
    n = 4000
    df = spark.createDataFrame(skewed(n), "id long, v int").selectExpr("*", "-v AS k")
    (cuts,), _ = measure_cuts(df, [(F.col("k"), F.col("id"))], rows_per_cell=100)
    cells = cuts.assign(df, "k", "id")
    largest = cells.groupBy(CODE, SUB).count().agg(F.max("count")).first()[0]
    assert largest <= 2 * n / 32 + 40
    # A third of the rows share one value, and its rows are spread over cells.
    assert cells.filter("v = 7").select(CODE, SUB).distinct().count() > 5


@pytest.mark.parametrize("ddl,convert", [
    ("decimal(18,2)", lambda v: Decimal(v) / 100),
    ("double", lambda v: v / 8),
    ("date", lambda v: datetime.date(2000, 1, 1) + datetime.timedelta(days=v)),
    ("timestamp_ntz", lambda v: datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=v, microseconds=v)),
    ("timestamp", lambda v: datetime.datetime(2000, 1, 1) + datetime.timedelta(minutes=v)),
])
def test_key_types(spark, ddl, convert):
    rows = skewed(200, seed=3)
    df = spark.createDataFrame(
        [(i, v, convert(v)) for i, v in rows], f"product_id long, v int, k {ddl}"
    )
    out = prefix.distributed_prefix(
        df, "k", "product_id", rank="r", row_number="n", rows_per_cell=9
    )
    want = brute(rows)
    assert {x.product_id: (x.r, x.n) for x in out.collect()} == {i: w[:2] for i, w in want.items()}


def test_null_keys_come_first(spark):
    df = spark.createDataFrame(
        [(1, None), (2, 5), (3, None), (4, 9)], "product_id long, v int"
    )
    for size in (1, 100):
        out = prefix.global_row_number(df, "v", rows_per_cell=size)
        assert [r.product_id for r in out.orderBy("row_number").collect()] == [1, 3, 4, 2]


@pytest.mark.parametrize("known", [0, 30])
def test_many_null_keys_are_spread(spark, known):
    rows = [(i, None if i >= known else i) for i in range(300)]
    df = spark.createDataFrame(rows, "product_id long, v int")
    out = prefix.global_row_number(df, "v", rows_per_cell=10)
    order = [r.product_id for r in out.orderBy("row_number").collect()]
    assert order == list(range(known, 300)) + list(range(known - 1, -1, -1))
    keyed = df.selectExpr("*", "-v AS k")
    (cuts,), _ = measure_cuts(keyed, [(F.col("k"), F.col("product_id"))], rows_per_cell=10)
    cells = cuts.assign(keyed, "k", "product_id")
    assert cells.groupBy(CODE, SUB).count().agg(F.max("count")).first()[0] <= 40


def test_wall_clock_keys_ignore_the_zone(spark):
    """Half past two does not exist on this night in the zone; order must hold."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stamps = [datetime.datetime(2024, 3, 10, 2, 30), datetime.datetime(2024, 3, 10, 3, 10)]
        df = spark.createDataFrame([(s,) for s in stamps], "t timestamp_ntz")
        keys = df.select("t", sort_key(F.col("t"), df.schema["t"].dataType).alias("k"))
        found = [r.k for r in keys.orderBy("t").collect()]
        assert found[1] - found[0] == 40 * 60 * 1_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_global_ranks_share_one_pass(spark):
    rows = [(i, v, (v * 31) % 17) for i, v in skewed(300, seed=5)]
    df = spark.createDataFrame(rows, "product_id long, a int, b int")
    out = prefix.global_ranks(df, {"ra": "a", "rb": "b"}, rows_per_cell=20)
    a, b = brute([(i, x) for i, x, _ in rows]), brute([(i, y) for i, _, y in rows])
    got = {r.product_id: (r.ra, r.rb) for r in out.collect()}
    assert got == {i: (a[i][0], b[i][0]) for i in a}


@pytest.mark.parametrize("rows_per_cell", [4, 100_000])
def test_quantiles_match_interpolation(spark, rows_per_cell):
    values = [v for _, v in skewed(301, seed=2)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    probabilities = [0.0, 0.2, 0.3, 0.77, 0.8, 1.0]
    got = prefix.quantiles(df, "v", probabilities, rows_per_cell)
    assert got == pytest.approx(list(np.quantile(values, probabilities)))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v int")
    assert prefix.quantiles(df, "v", [0.5]) == [None]


def test_quintile_label_closes_on_the_right(spark):
    df = spark.createDataFrame([(float(i),) for i in range(6)], "s double")
    out = prefix.quintile_label(df, "s", ["a", "b", "c", "d", "e"], "q")
    assert [r.q for r in out.orderBy("s").collect()] == ["a", "a", "b", "c", "d", "e"]


def test_dense_codes(spark):
    df = spark.createDataFrame([(30,), (10,), (None,), (30,), (2,)], "k int")
    found = {r.k: r.c for r in prefix.dense_codes(df, "k", "c").collect()}
    assert found == {2: 0, 10: 1, 30: 2, None: -1}


def test_with_totals(spark):
    df = spark.range(5)
    out = prefix.with_totals(df, {"t": F.sum("id"), "n": F.count("*")})
    assert {(r.t, r.n) for r in out.collect()} == {(10, 5)}


def test_large_sets_use_no_single_partition_window(spark):
    """Beyond one cell only the bounded cell totals meet in one task."""
    df = spark.createDataFrame(skewed(500), "product_id long, v int")
    out = prefix.global_row_number(df, "v", rows_per_cell=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert f"hashpartitioning({CODE}" in plan
