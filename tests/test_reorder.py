"""Alerts from readings that arrive in any order."""

import datetime
import os
import random

import pytest

from stocklens.sources.scratch import run_path
from stocklens.streaming import crossings, live, reorder

SCHEMA = "ts timestamp_ntz, product_id long, seq long, level double, min_level double, name string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def readings(seed=1, n=240, keys=5):
    rng = random.Random(seed)
    return [(at(i // 2), rng.randrange(keys) if i % 3 else 0, i, float(rng.randrange(11)), 5.0, f"n{i}")
            for i in range(n)]


def written(spark, path, parts):
    """One file per part, read in this order."""
    for number, part in enumerate(parts):
        target = path / f"{number:03}"
        if target.exists():
            continue
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(target))
        for file in target.glob("part-*"):
            os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
    return live.file_stream(spark, str(path / "*"), SCHEMA, files_per_trigger=1)


def closing(minute):
    return [(at(minute), None, None, None, None, None)]


def found(df):
    return sorted(map(tuple, df.collect()))


def expected(spark, rows):
    return found(crossings.crossing_alerts(spark.createDataFrame(rows, SCHEMA)))


@pytest.mark.parametrize("delay", [0, 7, 1000])
def test_any_order_gives_the_batch_alerts(spark, tmp_path, delay):
    """Delays in minutes up to the lateness; the hot key holds a third of the readings."""
    rows, rng = readings(), random.Random(delay)
    order = sorted(rows, key=lambda r: r[0] + datetime.timedelta(minutes=rng.uniform(0, delay)))
    parts = [order[i:i + 40] for i in range(0, len(order), 40)] + [closing(5000)]
    stream = reorder.reordered_alerts_stream(
        written(spark, tmp_path, parts), lateness=f"{delay + 1} minutes")
    got = found(live.run_to_files(stream, "t"))
    assert got == expected(spark, rows) and len(got) > 20


def test_an_overtaken_reading_still_raises_its_alert(spark, tmp_path):
    """9 at 1, 4 at 2, 8 at 3: the fall at 2 arrives last. The simple stream misses it."""
    rows = [(at(1), 1, 1, 9.0, 5.0, "a"), (at(2), 1, 2, 4.0, 5.0, "a"), (at(3), 1, 3, 8.0, 5.0, "a")]
    parts = [[rows[0], rows[2]], [rows[1]], closing(500)]
    stream = written(spark, tmp_path, parts)
    simple = live.run_to_files(crossings.crossing_alerts_stream(stream.where("seq IS NOT NULL")), "s")
    assert found(simple) == []
    got = live.run_to_files(reorder.reordered_alerts_stream(stream, lateness="10 minutes"), "t")
    assert [r.seq for r in got.collect()] == [2]


def test_readings_beyond_the_lateness_are_dropped_and_counted(spark, tmp_path):
    rows = [(at(1), 1, 1, 9.0, 5.0, "a"), (at(60), 1, 3, 9.0, 5.0, "a"),
            (at(61), 1, 4, 8.0, 5.0, "a"), (at(2), 1, 2, 4.0, 5.0, "a")]
    stream = written(spark, tmp_path, [[r] for r in rows] + [closing(500)])
    found_stream = reorder.reordered_alerts_stream(stream, lateness="5 minutes")
    out, checkpoint = run_path(spark, "o"), run_path(spark, "c")
    query = live.start_to_files(found_stream, out, checkpoint)
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress
                  for op in p["stateOperators"])
    assert dropped == 1 and spark.read.parquet(out).count() == 0


def test_waiting_readings_survive_a_restart(spark, tmp_path):
    rows = readings(seed=3, n=60, keys=2)
    random.Random(5).shuffle(rows)
    out, checkpoint = run_path(spark, "o"), run_path(spark, "c")
    parts = [rows[:20], rows[20:40], rows[40:], closing(5000)]
    for upto in (1, 3, 4):
        stream = written(spark, tmp_path, parts[:upto])
        alerts = reorder.reordered_alerts_stream(stream, lateness="2 hours")
        live.start_to_files(alerts, out, checkpoint).awaitTermination()
    assert found(spark.read.parquet(out)) == expected(spark, rows)


def test_nulls_and_ties(spark, tmp_path):
    """A null level crosses nothing, a null time is left out, equal times go by sequence."""
    rows = [(at(1), 1, 1, 9.0, 5.0, None), (at(1), 1, 2, 4.0, 5.0, None), (at(2), 1, 3, None, 5.0, "x"),
            (at(3), 1, 4, 3.0, 5.0, "x"), (at(4), 1, 5, 8.0, 5.0, "x"), (at(5), 1, 6, 0.0, 5.0, "x")]
    parts = [[rows[5], rows[1]], [rows[3], rows[0]], [rows[4], rows[2]],
             [(None, 1, 9, 0.0, 5.0, "x")], closing(900)]
    stream = reorder.reordered_alerts_stream(written(spark, tmp_path, parts), lateness="30 minutes")
    got = {r.seq: (r.level, r.priority) for r in live.run_to_files(stream, "t").collect()}
    assert got == {2: (4.0, "MEDIA"), 6: (0.0, "ALTA")}
