import datetime
import os

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from stocklens.functions import labels as L
from stocklens.sources.scratch import run_path
from stocklens.streaming import crossings, ledger, live, snapshot

SCHEMA = "product_id long, seq long, level double, min_level double, name string"

# Minimum 5: alerts on the first and the last fall; a first reading is silent.
LEVELS = [(1, [9, 5, 4, 9, 0]), (2, [3, 2]), (3, [6, 6, 5])]


def updates():
    rows, seq = [], 0
    for key, levels in LEVELS:
        for level in levels:
            rows.append((key, seq, float(level), 5.0, f"item {key}"))
            seq += 1
    return rows


EXPECTED = {(1, 1, "MEDIA"), (1, 4, "ALTA"), (3, 9, "MEDIA")}


def found(df):
    return {(r.product_id, r.seq, r.priority) for r in df.collect()}


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_batch_crossings(spark, hot_rows):
    df = spark.createDataFrame(updates(), SCHEMA)
    out = crossings.crossing_alerts(df, hot_rows)
    assert found(out) == EXPECTED
    assert out.filter("seq = 4").first().message == "Stock crítico: item 1 tiene solo 0.0 unidades"


def test_the_old_minimum_decides_what_was_above(spark):
    rows = [(1, 0, 8.0, 5.0, "x"), (1, 1, 8.0, 9.0, "x"), (1, 2, 7.0, 9.0, "x")]
    assert found(crossings.crossing_alerts(spark.createDataFrame(rows, SCHEMA))) == {(1, 1, "MEDIA")}


@pytest.mark.parametrize("per_file", [1, 3, 100])
def test_stream_equals_batch(spark, tmp_path, per_file):
    """State carries the last level from one micro-batch to the next."""
    rows = updates()
    for i in range(0, len(rows), per_file):
        part = spark.createDataFrame(rows[i : i + per_file], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.file_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)
    assert found(live.run_to_files(crossings.crossing_alerts_stream(stream), "t")) == EXPECTED


def test_stream_state_survives_a_restart(spark, tmp_path):
    rows = updates()
    source, out, checkpoint = str(tmp_path / "in"), run_path(spark, "o"), run_path(spark, "c")
    for part in (rows[:1], rows[1:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = crossings.crossing_alerts_stream(live.file_stream(spark, source, SCHEMA))
        live.start_to_files(stream, out, checkpoint).awaitTermination()
    assert found(spark.read.parquet(out)) == EXPECTED


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_ledger(tables, hot_rows):
    moved = ledger.apply_movements(tables.movements, hot_rows=hot_rows)
    assert {r.movement_id: r.stock for r in moved.collect()} == {
        1: 25, 2: 19, 3: 15, 4: 10, 5: 5, 6: 10, 7: 9
    }
    breaks = ledger.ledger_breaks(tables.movements, hot_rows=hot_rows).collect()
    assert {r.movement_id: (r.wrong_sum, r.gap) for r in breaks} == {6: (True, False), 7: (False, True)}


def test_stock_on_hand(tables):
    out = {r.product_id: (r.net_quantity, r.movements) for r in ledger.stock_on_hand(tables.movements).collect()}
    assert out == {1: (5, 4), 2: (-1, 1), 3: (2, 2)}


def test_stock_on_hand_as_a_stream(spark, tables, tmp_path):
    slim = tables.movements.select("product_id", "kind", "quantity")
    for product in (1, 3):
        slim.filter(f"product_id = {product}").coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    stream = live.file_stream(spark, str(tmp_path / "m"), slim.schema, files_per_trigger=1)
    query = (
        ledger.stock_on_hand(stream).writeStream.outputMode("complete").format("memory")
        .queryName("on_hand").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {r.product_id: r.net_quantity for r in spark.table("on_hand").collect()} == {1: 5, 3: 2}


NOW = "2024-03-02 00:00:00"
UPDATES = "product_id long, seq long, stock int, name string"


def test_upsert(spark, tables):
    rows = [(1, 1, 7, None), (1, 2, 8, "renamed"), (2, 3, 5, None), (77, 4, 1, "new")]
    after = snapshot.upsert_snapshot(tables.products, spark.createDataFrame(rows, UPDATES), NOW)
    got = {r.product_id: r for r in after.collect()}
    assert after.columns == tables.products.columns and len(got) == 10
    assert (got[1].stock, got[1].name) == (8, "renamed")
    stamp = datetime.datetime(2024, 3, 2)
    # An update that changes nothing still stamps the row; others keep theirs.
    assert (got[2].stock, got[2].updated_at) == (5, stamp)
    assert got[3].updated_at == datetime.datetime(2024, 3, 1)
    unknown = snapshot.unknown_updates(tables.products, spark.createDataFrame(rows, UPDATES))
    assert [r.product_id for r in unknown.collect()] == [77]


def test_upsert_stream(spark, tables, tmp_path):
    for part in ([(1, 1, 7, None)], [(1, 2, 8, None), (2, 3, 1, None)]):
        spark.createDataFrame(part, UPDATES).coalesce(1).write.mode("append").parquet(str(tmp_path / "u"))
    stream = live.file_stream(spark, str(tmp_path / "u"), UPDATES, files_per_trigger=1)
    last = snapshot.run_upsert(tables.products, stream, NOW)
    got = {r.product_id: r.stock for r in last.collect()}
    assert (got[1], got[2], got[3]) == (8, 1, 10)


def parts_in_order(spark, path, schema, parts):
    """One file per part, read in this order."""
    for number, part in enumerate(parts):
        target = path / f"{number}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(target))
        for file in target.glob("part-*"):
            os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
    return live.file_stream(spark, str(path / "*"), schema, files_per_trigger=1)


def test_an_older_update_in_a_later_batch_changes_nothing(spark, tables, tmp_path):
    parts = [[(1, 9, 99, None)], [(1, 2, 11, "old name")], [(1, 5, 50, None)]]
    stream = parts_in_order(spark, tmp_path, UPDATES, parts)
    last = {r.product_id: r for r in snapshot.run_upsert(tables.products, stream, NOW).collect()}
    assert (last[1].stock, last[1].name) == (99, "old name")


def test_a_missing_version_fails(spark, tables, tmp_path):
    stream = parts_in_order(spark, tmp_path / "u", UPDATES, [[(1, 1, 7, None)], [(1, 2, 8, None)]])
    directory = tmp_path / "versions"
    checkpoint = str(tmp_path / "checkpoint")

    def run(updates):
        writer = snapshot.upsert_stream(tables.products, updates, str(directory), NOW)
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    run(stream)
    (directory / "version=1").rename(directory / "elsewhere")
    part = spark.createDataFrame([(2, 3, 9, None)], UPDATES).coalesce(1)
    part.write.parquet(str(tmp_path / "u" / "later"))
    with pytest.raises(StreamingQueryException, match="is missing"):
        run(stream)


def test_late_readings_raise_no_alert(spark, tmp_path):
    """Key 1: 9 at 1, 4 at 5, then 2 arrives late; 3 at 6 is silent, since 5 was below."""
    rows = [[(1, 1, 9.0, 5.0, "a"), (1, 5, 4.0, 5.0, "a")], [(1, 2, 9.0, 5.0, "a")],
            [(1, 6, 3.0, 5.0, "a")]]
    stream = parts_in_order(spark, tmp_path, SCHEMA, rows)
    out = live.run_to_files(crossings.crossing_alerts_stream(stream), "t")
    assert {r.seq for r in out.collect()} == {5}


EVENTS = "ts timestamp_ntz, kind string, amount double"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_live_kpis_batch(spark):
    df = spark.createDataFrame([(at(0), L.KIND_IN, 1.5), (at(4), L.KIND_IN, 2.0), (at(5), L.KIND_OUT, 1.0)], EVENTS)
    got = {(r.window_start, r.kind): (r.movements, float(r.amount)) for r in live.live_kpis(df).collect()}
    assert got == {(at(0), L.KIND_IN): (2, 3.5), (at(5), L.KIND_OUT): (1, 1.0)}


def test_live_kpis_drop_late_rows(spark, tmp_path):
    """A row is late by the watermark with which the batch before ended.

    Minute 40 lifts the watermark to 30; one batch later minute 2 is dropped.
    """
    minutes = [(1, 1.0), (40, 1.0), (41, 1.0), (2, 9.0), (80, 1.0)]
    for number, (minute, amount) in enumerate(minutes):
        path = tmp_path / "e" / f"{number}.parquet"
        path.parent.mkdir(exist_ok=True)
        pd.DataFrame({"ts": [at(minute)], "kind": ["a"], "amount": [amount]}).to_parquet(
            path, coerce_timestamps="us", use_deprecated_int96_timestamps=False
        )
        # The file source reads the oldest file first.
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
    stream = live.file_stream(spark, str(tmp_path / "e"), EVENTS, files_per_trigger=1)
    out = live.run_to_files(live.live_kpis(stream), "k").collect()
    assert {r.window_start: float(r.amount) for r in out} == {at(0): 1.0, at(40): 2.0}


def test_live_kpis_keep_open_windows_and_wall_clock_times(spark, tmp_path):
    """In a zone whose clock skips 02:00-03:00 both windows of that hour are told apart."""
    skipped = [datetime.datetime(2024, 3, 31, 2, 31), datetime.datetime(2024, 3, 31, 3, 31)]
    rows = [(t, "a", 1.0) for t in skipped]
    stream = parts_in_order(spark, tmp_path, EVENTS, [rows[:1], rows[1:], rows[1:]])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        out = live.run_updates(
            live.live_kpis(stream), ("window_start", "window_end", "kind"), "k").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    starts = [t.replace(minute=30) for t in skipped]
    assert {r.window_start: r.movements for r in out} == {starts[0]: 1, starts[1]: 2}


def test_the_registered_crossings_stream_bounds_its_batches(spark, monkeypatch, tmp_path):
    """A third of the events is one user's; a file holds so many rows, in sequence, at any size."""
    import inventory_queries as queries

    monkeypatch.setattr(queries, "EVENT_ROWS", 50)
    monkeypatch.setattr(queries, "run_path", lambda spark, label: str(tmp_path / label))
    events = spark.range(700).selectExpr(
        "id as event_id", "if(id % 3 = 0, 1, id % 20) as user_id",
        f"{queries.star.LEVEL_MIN} + pmod(hash(id), 21) - 10.0D as value", "'view' as event_type",
        "timestamp_ntz'2001-01-01 00:00:00' as ts", "'{}' as props")
    schema = spark.createDataFrame([], queries.star.STAR_SCHEMAS["events"]).schema
    typed = events.select(*[events[f.name].cast(f.dataType) for f in schema])
    typed.repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    rows = queries.MOVEMENTS["crossing_alerts_stream"](spark, str(tmp_path)).collect()
    batch = queries.MOVEMENTS["crossing_alerts"](spark, str(tmp_path)).collect()
    assert sorted(rows) == sorted(batch) and rows
    files = sorted((tmp_path / "events").glob("*.parquet"), key=os.path.getmtime)
    held = [[r.event_id for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert max(map(len, held)) <= 50
    assert [i for ids in held for i in ids] == list(range(700))
