"""The snapshot with delta runs against its batch twin."""

import datetime
import random
from pathlib import Path

import pytest

from stocklens.sources.scratch import run_path
from stocklens.streaming import delta_runs, live, snapshot

UPDATES = "product_id long, seq long, stock int, name string"
NOW = "2024-03-02 00:00:00"


def batches(count, size, seed=1, keys=12):
    """Updates in any order, some of unknown or null keys, some that set one column only."""
    rng = random.Random(seed)
    numbers = list(range(count * size))
    rng.shuffle(numbers)
    return [[(rng.choice([*range(1, keys), None]), n, rng.choice((None, n)),
              rng.choice((None, f"name {n}"))) for n in numbers[i * size:(i + 1) * size]]
            for i in range(count)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def applied(spark, tables, parts, now=NOW, **options):
    directory = run_path(spark, "delta-test")
    delta_runs.create(tables.products, directory, ["stock", "name"], buckets=4)
    for number, part in enumerate(parts, 1):
        delta_runs.apply_batch(
            spark.createDataFrame(part, UPDATES), directory, number, now, **options)
    return directory


@pytest.mark.parametrize("fanout,fold", [(2, 0.4), (2, 100), (3, 0.01), (100, 1)])
def test_equals_the_batch_twin(spark, tables, fanout, fold):
    parts = batches(7, 6)
    directory = applied(spark, tables, parts, fanout=fanout, fold=fold)
    every = spark.createDataFrame([r for p in parts for r in p], UPDATES)
    expected = snapshot.upsert_snapshot(tables.products, every, NOW)
    got = delta_runs.read_snapshot(spark, directory)
    assert got.columns == expected.columns and rows(got) == rows(expected)
    version = delta_runs.read_commit(spark, directory)
    levels = [r.level for r in version.runs]
    assert all(levels.count(x) < fanout for x in levels)
    assert (version.base != "base/0") == (fold < 1)


def test_every_batch_has_its_stamp(spark, tables):
    directory = run_path(spark, "delta-test")
    delta_runs.create(tables.products, directory, ["stock"])
    for number, key in enumerate((1, 2, 1, 3), 1):
        part = spark.createDataFrame([(key, 10 - number, number, None)], UPDATES)
        delta_runs.apply_batch(part, directory, number, f"2024-03-0{number} 00:00:00", fanout=2)
    got = {r.product_id: (r.stock, r.updated_at.day) for r in
           delta_runs.read_snapshot(spark, directory).where("product_id < 5").collect()}
    # The third update is older than the first by its number, and stamps the row all the same.
    assert got[1] == (1, 3) and got[2] == (2, 2) and got[3] == (4, 4) and got[4][0] == 11


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_a_batch_writes_what_it_updates(spark, tmp_path):
    """Small batches on a larger snapshot: no batch rewrites it, all together stay far below it."""
    products = spark.range(200_000).selectExpr(
        "id as product_id", "cast(id % 50 as int) as stock", "uuid() as name",
        "timestamp_ntz'2024-01-01 00:00:00' as updated_at")
    directory = str(tmp_path / "d")
    delta_runs.create(products, directory, ["stock", "name"])
    base, written = size(directory), []
    for number in range(1, 10):
        updates = [(k * 7, number * 100 + k, k, None) for k in range(40)]
        before = {f for f in Path(directory).rglob("*.parquet")}
        delta_runs.apply_batch(spark.createDataFrame(updates, UPDATES), directory, number, NOW)
        new = {f for f in Path(directory).rglob("*.parquet")} - before
        written.append(sum(f.stat().st_size for f in new))
    assert max(written) < base / 20 and sum(written) < base / 5


def test_only_the_buckets_of_the_keys_are_read(spark, tables):
    directory = applied(spark, tables, batches(3, 6))
    every = {r.product_id: r for r in delta_runs.read_snapshot(spark, directory).collect()}
    some = delta_runs.read_snapshot(spark, directory, keys=[2, 5, 999])
    assert {r.product_id: r for r in some.collect()} == {k: every[k] for k in (2, 5)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket", "[_bucket") or (
        "_bucket#" in plan.split("PartitionFilters")[1].split("]")[0])


def test_a_batch_may_be_run_again_and_none_left_out(spark, tables):
    parts = batches(4, 6)
    directory = applied(spark, tables, parts[:2], fanout=2)
    before = rows(delta_runs.read_snapshot(spark, directory))
    again = spark.createDataFrame(parts[2], UPDATES)
    delta_runs.apply_batch(again, directory, 2, NOW)  # that version is there
    assert rows(delta_runs.read_snapshot(spark, directory)) == before
    with pytest.raises(FileNotFoundError, match="version 3 is missing"):
        delta_runs.apply_batch(again, directory, 4, NOW)


def test_a_failure_half_way_leaves_the_earlier_version(spark, tables, monkeypatch):
    """Files of a batch that was not published are replaced by the next attempt."""
    parts = batches(3, 6)
    directory = applied(spark, tables, parts[:1], fanout=2)
    before = rows(delta_runs.read_snapshot(spark, directory))
    batch = spark.createDataFrame(parts[1], UPDATES)

    def broken(*args):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(delta_runs, "_commit", broken)
        with pytest.raises(OSError, match="lost"):
            delta_runs.apply_batch(batch, directory, 2, NOW, fanout=2)
    assert rows(delta_runs.read_snapshot(spark, directory)) == before
    delta_runs.apply_batch(batch, directory, 2, NOW, fanout=2)
    every = spark.createDataFrame([r for p in parts[:2] for r in p], UPDATES)
    assert rows(delta_runs.read_snapshot(spark, directory)) == rows(
        snapshot.upsert_snapshot(tables.products, every, NOW))


def test_old_files_go(spark, tables):
    directory = applied(spark, tables, batches(6, 6), fanout=2)
    numbers = delta_runs.versions(spark, directory)
    assert numbers == [5, 6]
    named = set().union(*(delta_runs.read_commit(spark, directory, n).files() for n in numbers))
    there = {f"{p.parent.name}/{p.name}" for k in ("runs", "base") for p in Path(directory, k).iterdir()}
    assert there == named
    assert delta_runs.read_snapshot(spark, directory, 5).count() == tables.products.count()


def test_empty_batches_and_tables(spark, tables):
    directory = run_path(spark, "delta-test")
    delta_runs.create(tables.products.limit(0), directory, ["stock"])
    delta_runs.apply_batch(spark.createDataFrame([], UPDATES), directory, 1, NOW)
    delta_runs.apply_batch(spark.createDataFrame([(1, 1, 1, "x")], UPDATES), directory, 2, NOW)
    assert delta_runs.read_snapshot(spark, directory).count() == 0
    assert delta_runs.create(tables.products, directory, ["stock"]).number == 2


def test_stream(spark, tables, tmp_path):
    parts = batches(5, 5)
    for part in parts:
        spark.createDataFrame(part, UPDATES).coalesce(1).write.mode("append").parquet(str(tmp_path / "u"))
    stream = live.file_stream(spark, str(tmp_path / "u"), UPDATES, files_per_trigger=1)
    got = delta_runs.run_upsert(tables.products, stream, NOW, fanout=2)
    every = spark.createDataFrame([r for p in parts for r in p], UPDATES)
    assert rows(got) == rows(snapshot.upsert_snapshot(tables.products, every, NOW))
    assert datetime.datetime(2024, 3, 2) in {r.updated_at for r in got.collect()}
