"""Streams whose state functions work on many keys at once."""

import datetime
import os
import random

import pytest

from stocklens.functions import labels as L
from stocklens.sources.scratch import run_path
from stocklens.streaming import buckets, crossings, ledger, ledger_stream, live, reorder

SCHEMA = "ts timestamp_ntz, product_id long, seq long, level double, min_level double, name string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def files(spark, path, parts, schema=SCHEMA):
    """One file per part, read in this order."""
    for number, part in enumerate(parts):
        target = path / f"{number:03}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(target))
        for file in target.glob("part-*"):
            os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
    return live.file_stream(spark, str(path / "*"), schema, files_per_trigger=1)


def written(spark, stream):
    """What the stream writes, and the progress of its state in the last micro-batch."""
    out = run_path(spark, "o")
    query = live.start_to_files(stream, out, run_path(spark, "c"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query.lastProgress["stateOperators"][0]


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def readings(keys, times, seed=1):
    """Every key has one reading a minute."""
    rng = random.Random(seed)
    return [(at(m), k, m * keys + i, float(rng.randrange(11)), 5.0, rng.choice(["a", "b", None]))
            for m in range(times) for i, k in enumerate([None, *range(2**60, 2**60 + keys - 1)])]


def test_crossings_hold_many_keys_in_few_groups(spark, tmp_path):
    """A thousand large keys and the missing one; one group of state a bucket, not a key."""
    rows = readings(1000, 6)
    stream = files(spark, tmp_path, [rows[i:i + 1500] for i in range(0, 6000, 1500)])
    got, state = written(spark, crossings.crossing_alerts_stream(stream))
    expected = found(crossings.crossing_alerts(spark.createDataFrame(rows, SCHEMA)))
    assert found(got) == expected and any(r[0] is None for r in expected)
    assert state["numRowsTotal"] <= buckets.BUCKETS


def test_late_and_repeated_readings_of_a_bucket(spark, tmp_path):
    """With one bucket for all: a late reading changes nothing, whatever the other keys do."""
    parts = [[(at(1), 1, 1, 9.0, 5.0, "a"), (at(1), 2, 4, 9.0, 5.0, "a")],
             [(at(1), 2, 3, 1.0, 5.0, "b"), (at(1), 1, 1, 2.0, 5.0, "b")],
             [(at(1), 1, 5, 0.0, 5.0, "c"), (at(1), 1, 6, 9.0, 5.0, "c"), (at(1), 2, 7, None, 5.0, "c")],
             [(at(1), 1, 7, 5.0, 5.0, "d"), (at(1), 2, 8, 3.0, 5.0, "d")]]
    got, _ = written(spark, crossings.crossing_alerts_stream(files(spark, tmp_path, parts), buckets=1))
    assert [(r.product_id, r.seq) for r in got.orderBy("product_id", "seq").collect()] == [(1, 5), (1, 7)]


def test_first_readings_need_a_sequence_number(spark, tmp_path):
    stream = crossings.crossing_alerts_stream(files(spark, tmp_path, [[(at(1), 1, None, 9.0, 5.0, "a")]]))
    with pytest.raises(Exception, match="sequence number"):
        written(spark, stream)


def test_keys_of_text(spark, tmp_path):
    schema = SCHEMA.replace("product_id long", "product_id string")
    rows = [(t, None if k is None else f"k{k}", *more) for t, k, *more in readings(20, 8)]
    stream = files(spark, tmp_path, [rows[:70], rows[70:]], schema)
    got, _ = written(spark, crossings.crossing_alerts_stream(stream))
    assert found(got) == found(crossings.crossing_alerts(spark.createDataFrame(rows, schema)))


def test_state_has_no_more_partitions_than_cores(spark, tmp_path):
    """The setting may grow with the tables; micro-batches do not."""
    rows = readings(50, 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    try:
        stream = files(spark, tmp_path, [rows[:100], rows[100:]])
        got, state = written(spark, crossings.crossing_alerts_stream(stream))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "32"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert state["numShufflePartitions"] <= max(live.STATE_PARTITIONS, spark.sparkContext.defaultParallelism)
    assert found(got) == found(crossings.crossing_alerts(spark.createDataFrame(rows, SCHEMA)))


def test_waiting_readings_of_many_keys_lie_in_few_groups(spark, tmp_path):
    """Any order of arrival; the readings without a key close the stream and raise no alert."""
    rows = [r for r in readings(1000, 6) if r[1] is not None]
    random.Random(4).shuffle(rows)
    parts = [*(rows[i:i + 1500] for i in range(0, len(rows), 1500)), [(at(500), None, None, None, None, None)]]
    stream = reorder.reordered_alerts_stream(files(spark, tmp_path, parts), lateness="10 minutes")
    got, state = written(spark, stream)
    expected = found(crossings.crossing_alerts(spark.createDataFrame(rows, SCHEMA)))
    assert found(got) == expected and len(expected) > 1000
    assert state["numRowsTotal"] <= buckets.BUCKETS


def test_levels_of_many_products_lie_in_few_groups(spark, tmp_path):
    """A thousand products with late and repeated movements, nulls and large numbers."""
    rng, schema = random.Random(2), ("movement_id long, product_id long, kind string, quantity int, "
                                     "moved_at timestamp_ntz, stock_before long, stock_after long")
    kinds = (L.KIND_OUT, L.KIND_IN, None, "OTRO", L.KIND_LOSS)
    rows = [(rng.choice([None, 2**60 + i]), 2**60 + i % 1000, rng.choice(kinds), rng.choice([None, 1, 2, 7]),
             at(i // 500), rng.choice([None, 2**59 + 1]), rng.choice([None, 2**59 + 3])) for i in range(4000)]
    rows += rows[::50]
    rng.shuffle(rows)
    stream = files(spark, tmp_path, [rows[i:i + 1200] for i in range(0, len(rows), 1200)], schema)
    got, state = written(spark, ledger_stream.ledger_changes_stream(stream, "1 hour"))
    stand, batch = ledger_stream.settled(got), spark.createDataFrame(rows, schema)
    columns = ("product_id", "movement_id", "kind", "quantity", "moved_at")
    assert found(stand.select(*columns, "stock")) == found(ledger.apply_movements(batch).select(*columns, "stock"))
    columns = (*columns, "wrong_sum", "gap")
    assert found(stand.where("wrong_sum OR gap").select(*columns)) == found(
        ledger.ledger_breaks(batch).select(*columns))
    assert state["numRowsTotal"] <= buckets.BUCKETS


def test_breaks_are_taken_back_after_movements_were_folded(spark, tmp_path):
    """One bucket for two products; what the watermark passed is the level before the next movement."""
    schema = ("movement_id long, product_id long, kind string, quantity int, "
              "moved_at timestamp_ntz, stock_before int, stock_after int")
    parts = [[(1, 1, L.KIND_IN, 5, at(0), 10, 15), (2, 1, L.KIND_IN, 1, at(200), 17, 18),
              (3, 2, L.KIND_IN, 5, at(0), 10, 15)],
             [(4, 1, L.KIND_IN, 2, at(190), 15, 17), (5, 2, L.KIND_IN, 1, at(200), 16, 17)],
             [(6, 2, L.KIND_OUT, 1, at(199), 15, 16)]]
    stream = files(spark, tmp_path, parts, schema)
    got, _ = written(spark, ledger_stream.ledger_changes_stream(stream, "20 minutes", buckets=1))
    shown = sorted((r.movement_id, r.stock, r.wrong_sum, r.gap, r.change) for r in got.collect())
    assert shown == [(1, 15, False, False, 1), (2, 16, False, True, -1), (2, 16, False, True, 1),
                     (2, 18, False, False, 1), (3, 15, False, False, 1), (4, 17, False, False, 1),
                     (5, 15, False, False, 1), (5, 16, False, True, -1), (5, 16, False, True, 1),
                     (6, 14, True, False, 1)]


def test_events_are_dealt_to_full_files(spark, monkeypatch, tmp_path):
    """At most one file of a task is a remainder: each file is a micro-batch that reads all that waits."""
    import inventory_queries as queries

    monkeypatch.setattr(queries, "EVENT_ROWS", 50)
    monkeypatch.setattr(queries, "run_path", lambda spark, label: str(tmp_path / label))
    spark.range(3000).selectExpr(
        "id as event_id", "id % 20 as user_id", "100D as value", "'view' as event_type",
        "timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(0, 0, id) as ts", "'{}' as props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    # As with large tables, the cuts are estimated from few rows a task.
    setting = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    spark.conf.set(setting, 5)
    try:
        queries._late_events(spark, str(tmp_path), 1)
    finally:
        spark.conf.unset(setting)
    files = list((tmp_path / "late-events").glob("*.parquet"))
    held = [spark.read.parquet(str(f)).count() for f in files]
    assert sum(held) == 3001 and max(held) <= 50
    assert sum(n < 50 for n in held) <= 3000 / 50 / queries.TASK_FILES + 1


def test_sums_have_no_more_partitions_than_cores(spark, tmp_path):
    """Each micro-batch writes as many files as the state has partitions."""
    schema = "product_id long, kind string, quantity int"
    rows = [(i % 300, L.KIND_IN, 1) for i in range(900)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    try:
        sums = ledger.stock_on_hand(files(spark, tmp_path / "in", [rows[:400], rows[400:]], schema))
        out = run_path(spark, "o")
        query = live.start_updates(sums, out, run_path(spark, "c"))
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    most = max(live.STATE_PARTITIONS, spark.sparkContext.defaultParallelism)
    assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] <= most
    assert len(spark.read.parquet(out).inputFiles()) <= 2 * most
    got = live.latest_rows(spark, out, ("product_id",))
    assert found(got) == [*sorted(((i, 3, 3) for i in range(300)), key=str)]
