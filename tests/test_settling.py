"""Window sums that close and are corrected, and table sets that are published as a whole."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from stocklens.sources import commits, sinks
from stocklens.sources.scratch import run_path
from stocklens.streaming import live, settling

SCHEMA = "ts timestamp_ntz, kind string, amount double"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def batches(delay, n=300, size=60, seed=2):
    rng = random.Random(seed)
    rows = [(i + rng.uniform(0, delay), (at(i), rng.choice("abc"), float(rng.randrange(9)))) for i in range(n)]
    rows = [r for _, r in sorted(rows, key=lambda x: x[0])]
    return [rows[i:i + size] for i in range(0, n, size)]


def sums(df):
    return sorted(map(tuple, df.collect()))


def settled(spark, parts, lateness="10 minutes"):
    directory = run_path(spark, "settling-test")
    done = [settling.settle_batch(spark.createDataFrame(p, SCHEMA), directory, i, lateness=lateness)
            for i, p in enumerate(parts)]
    return directory, done


@pytest.mark.parametrize("delay", [0, 30, 500])
def test_nothing_is_lost_and_state_is_bounded(spark, delay):
    """Delays far beyond the lateness: the sums are the batch sums, kept windows span the lateness."""
    parts = batches(delay)
    directory, done = settled(spark, parts)
    every = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    assert sums(settling.read_sums(spark, directory)) == sums(live.live_kpis(every))
    assert (sum(d["corrections"] for d in done) > 0) == (delay > 10)
    # Kept windows begin less than the lateness and a window before the newest time.
    assert all(d["open"] <= 3 * (60 + 15) // 5 for d in done)
    last = spark.read.parquet(settling._place(directory, "open", len(parts) - 1))
    newest = datetime.datetime.fromisoformat(done[-1]["newest"])
    assert min(r.window_end for r in last.collect()) > newest - datetime.timedelta(minutes=10)


def test_a_closed_window_changes_by_corrections_only(spark):
    parts = [[(at(1), "a", 1.0)], [(at(40), "a", 1.0)], [(at(2), "a", 5.0)], [(at(41), "a", 2.0)]]
    directory, done = settled(spark, parts)
    assert [(d["final"], d["corrections"], d["open"]) for d in done] == [
        (0, 0, 1), (1, 0, 1), (0, 1, 1), (0, 0, 1)]
    final = {r.window_start: float(r.amount) for r in
             settling.read_sums(spark, directory, final_only=True).collect()}
    assert final == {at(0): 6.0}


def test_a_batch_may_be_run_again(spark, monkeypatch):
    """Half a batch is not read, and running it again gives each row once."""
    parts = batches(30)
    directory, _ = settled(spark, parts[:2])
    before = sums(settling.read_sums(spark, directory))
    third = spark.createDataFrame(parts[2], SCHEMA)

    def broken(*args):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(commits, "publish", broken)
        with pytest.raises(OSError, match="lost"):
            settling.settle_batch(third, directory, 2, lateness="10 minutes")
    assert sums(settling.read_sums(spark, directory)) == before
    for _ in range(2):
        settling.settle_batch(third, directory, 2, lateness="10 minutes")
    every = spark.createDataFrame([r for p in parts[:3] for r in p], SCHEMA)
    assert sums(settling.read_sums(spark, directory)) == sums(live.live_kpis(every))


def test_empty_and_timeless_rows(spark):
    directory, done = settled(spark, [[(None, "a", 1.0)], [(at(1), None, None)]])
    assert done[0]["newest"] is None and len(sums(settling.read_sums(spark, directory))) == 1
    assert settling.read_sums(spark, run_path(spark, "none")).count() == 0


def test_stream(spark, tmp_path):
    parts = batches(100)
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = live.file_stream(spark, str(tmp_path / "e"), SCHEMA, files_per_trigger=1)
    got, directory = settling.run_settling(stream)
    every = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    assert sums(got) == sums(live.live_kpis(every))
    assert len(commits.numbers(spark, directory)) <= settling.KEPT
    assert not any((Path(directory) / "batches").iterdir())


def test_a_set_of_tables_is_published_as_a_whole(spark, tables, tmp_path, monkeypatch):
    """A failure half way leaves the set before; old sets go."""
    held = {"products": tables.products, "categories": tables.categories}
    directory = str(tmp_path / "sets")
    assert sinks.publish_tables(held, directory, "2024-01-01") == 1
    broken = spark.range(1).selectExpr("cast(raise_error('lost') AS string) AS x")
    with pytest.raises(PySparkException):
        sinks.publish_tables({"products": tables.products.limit(1), "categories": broken}, directory, "x")
    stamp, read = sinks.published_tables(spark, directory)
    assert stamp == "2024-01-01" and read["products"].count() == tables.products.count()
    for day in (2, 3):
        sinks.publish_tables(held, directory, f"2024-01-0{day}")
    assert sinks.published_tables(spark, directory)[0] == "2024-01-03"
    assert sinks.published_tables(spark, directory, 2)[0] == "2024-01-02"
    with pytest.raises(FileNotFoundError):
        sinks.published_tables(spark, directory, 1)
    assert len(list((tmp_path / "sets" / "sets").iterdir())) <= 3
