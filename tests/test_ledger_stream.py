"""The ledger as a stream with late movements against its batch twins."""

import datetime
import os
import random

import pytest

from stocklens.functions import labels as L
from stocklens.streaming import ledger, ledger_stream, live

SCHEMA = ("movement_id long, product_id long, kind string, quantity int, moved_at timestamp_ntz, "
          "stock_before int, stock_after int")
KINDS = (L.KIND_IN, L.KIND_OUT, L.KIND_LOSS, L.KIND_ADJUST)


def at(hour):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


def movements(seed=1, n=150):
    """A third belongs to one product; some levels are wrong, absent or out of step."""
    rng, out, level = random.Random(seed), [], {}
    for i in range(n):
        product = 0 if i % 3 == 0 else rng.randrange(1, 5)
        kind, quantity = rng.choice(KINDS), rng.randrange(1, 9)
        before = level.get(product, rng.randrange(20))
        after = before + (quantity if kind in (L.KIND_IN, L.KIND_ADJUST) else -quantity)
        after += rng.random() < 0.1
        level[product] = after if rng.random() < 0.9 else after + 3
        before, after = (None if rng.random() < 0.1 else x for x in (before, after))
        if rng.random() < 0.05:
            quantity = None
        out.append((i, product, kind, quantity, at(i // 3), before, after))
    return out


def files(spark, path, parts):
    for number, part in enumerate(parts):
        target = path / f"{number:03}"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(target))
        for file in target.glob("part-*"):
            os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
    return live.file_stream(spark, str(path / "*"), SCHEMA, files_per_trigger=1)


def changes(spark, path, parts, **options):
    stream = ledger_stream.ledger_changes_stream(files(spark, path, parts), **options)
    return live.run_to_files(stream, "changes")


KEYS = ("product_id", "movement_id", "kind", "quantity", "moved_at")


def rows(df, *more):
    return sorted((tuple(r) for r in df.select(*KEYS, *more).collect()), key=str)


def same_as_batch(spark, found, given):
    frame = spark.createDataFrame(given, SCHEMA)
    stand = ledger_stream.settled(found)
    assert rows(stand, "stock") == rows(ledger.apply_movements(frame), "stock")
    breaks = stand.where("wrong_sum OR gap")
    assert rows(breaks, "wrong_sum", "gap") == rows(ledger.ledger_breaks(frame), "wrong_sum", "gap")


@pytest.mark.parametrize("delay,size", [(0, 50), (6, 30), (1000, 40)])
def test_equals_the_batch_twins(spark, tmp_path, delay, size):
    """Delays in hours within the lateness; product 0 has a third of the movements."""
    given, rng = movements(), random.Random(delay)
    order = sorted(given, key=lambda r: r[4] + datetime.timedelta(hours=rng.uniform(0, delay)))
    parts = [order[i:i + size] for i in range(0, len(order), size)]
    found = changes(spark, tmp_path, parts, lateness=f"{delay + 1} hours")
    same_as_batch(spark, found, given)
    assert (found.where("change < 0").count() > 0) == (delay > 0)


def test_a_late_movement_takes_levels_back(spark, tmp_path):
    """+5 at 1 and -1 at 3 are given as 15 and 14; +2 at 2 changes the second to 16."""
    one = (1, 7, L.KIND_IN, 5, at(1), 10, 15)
    two, three = (2, 7, L.KIND_IN, 2, at(2), 15, 17), (3, 7, L.KIND_OUT, 1, at(3), 17, 16)
    found = changes(spark, tmp_path, [[one, three], [two]])
    got = sorted((r.movement_id, r.stock, r.gap, r.change) for r in found.collect())
    assert got == [(1, 15, False, 1), (2, 17, False, 1), (3, 14, True, -1), (3, 14, True, 1),
                   (3, 16, False, 1)]


def test_a_new_first_movement_sets_the_opening(spark, tmp_path):
    given = [(2, 7, L.KIND_IN, 1, at(5), 50, 51), (1, 7, L.KIND_IN, 1, at(4), 20, 21)]
    found = changes(spark, tmp_path, [given[:1], given[1:]])
    same_as_batch(spark, found, given)
    assert {r.movement_id: r.stock for r in ledger_stream.settled(found).collect()} == {1: 21, 2: 22}


def test_balances_of_an_earlier_ledger(spark, tmp_path):
    """A ledger cut in two gives what it gives whole; its second half starts from the first one's end."""
    given = movements(seed=5)
    whole = ledger.apply_movements(spark.createDataFrame(given, SCHEMA))
    half = ledger.apply_movements(spark.createDataFrame(given[:75], SCHEMA))
    found = changes(spark, tmp_path, [given[75:110], given[110:]],
                    openings=ledger_stream.closing_balances(half))
    expected = rows(whole.where("movement_id >= 75"), "stock")
    assert rows(ledger_stream.settled(found), "stock") == expected


def test_state_holds_what_may_be_overtaken(spark, tmp_path):
    """Old movements are folded into the balance: kept rows stay few, levels go on."""
    given = [(i, 1, L.KIND_IN, 1, at(i), i, i + 1) for i in range(200)]
    parts = [given[i:i + 20] for i in range(0, 200, 20)]
    found = changes(spark, tmp_path, parts, lateness="3 hours")
    assert {r.movement_id: r.stock for r in found.collect()} == {i: i + 1 for i in range(200)}
    late = changes(spark, tmp_path / "late", [*parts, [(999, 1, L.KIND_IN, 1, at(2), 0, 1)]],
                   lateness="3 hours")
    assert late.where("movement_id = 999 OR change < 0").count() == 0


def test_repeated_rows_and_missing_keys(spark, tmp_path):
    one = (1, 7, L.KIND_IN, 5, at(1), 10, 15)
    given = [one, one, (2, 7, "OTRO", None, at(1), None, None)]
    found = changes(spark, tmp_path, [given, [one, (3, None, L.KIND_IN, 1, at(1), 0, 1),
                                              (4, 7, L.KIND_IN, 1, None, 0, 1)]])
    same_as_batch(spark, found, [*given, one])
