"""T2 as a stream: running stock and breaks of a ledger whose movements arrive late.

A movement that arrives in order adds one row. One that belongs before others
changes their levels: these are taken back (``change`` = -1) and given anew
(+1), so the sum of all changes is at any time what the batch twins
(``ledger.apply_movements``, ``ledger.ledger_breaks``) give for the movements so
far. A product keeps its balance and the movements that may still be
overtaken; what the watermark has passed is folded into the balance. The
products lie in ``buckets``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stocklens.streaming.buckets import (
    BUCKET,
    BUCKETS,
    arrays,
    bounds,
    bucket_of,
    joined,
    nullable,
    packed,
    unpacked,
    whole,
)
from stocklens.streaming.ledger import signed_quantity
from stocklens.streaming.reorder import wall_clock_time

_LONG, _FLAG, _TEXT = T.LongType(), T.BooleanType(), T.StringType()
#: A movement as it is given out: its place in the ledger, what it does, and its levels.
_GIVEN_OUT = {"time": _LONG, "movement_id": _LONG, "kind": _TEXT, "quantity": _LONG, "signed": _LONG,
              "stock_before": _LONG, "stock_after": _LONG, "stock": _LONG, "wrong_sum": _FLAG, "gap": _FLAG}
#: Its numbers that may be null. They are held as 0, with a bit each in ``_ABSENT``.
_NULLABLE = ["movement_id", "quantity", "signed", "stock_before", "stock_after", "stock"]
_ABSENT, _NO_OPENING = "_absent", "_no_opening"
_FRESH = ["product_id", "time", *_NULLABLE[:-1], _ABSENT]
_ROWS = [*_FRESH, "kind", "stock", "wrong_sum", "gap"]
#: Of a product: ``opening``, the balance before the kept movements, unknown while their first one
#: still tells it; ``moved``: whether a quantity was folded; ``previous``: level after the last
#: folded movement.
_BALANCE = {"opening": np.int64, "known": bool, "moved": bool, "previous": np.int64, "follows": bool}
#: Balances and kept movements of a bucket's products as columns; ``kind`` is a place in ``kinds``.
_STATE = T.StructType([
    T.StructField("balances", T.BinaryType()), T.StructField("rows", T.BinaryType()),
    T.StructField("kinds", T.ArrayType(_TEXT))])
_OUT = T.StructType([T.StructField("product_id", _LONG),
                     *(T.StructField(n, t) for n, t in _GIVEN_OUT.items()),
                     T.StructField("change", T.IntegerType())])


def _absent(rows: dict[str, np.ndarray], name: str) -> np.ndarray:
    return rows[_ABSENT] >> _NULLABLE.index(name) & 1 == 1


def _within(running: np.ndarray, each: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A running sum over all rows as one that begins anew with each group."""
    return running - (running[starts] - each[starts])[group]


def _levels(rows: dict[str, np.ndarray], product: np.ndarray, balance: dict[str, np.ndarray]) -> tuple:
    """Of the sorted rows: level, whether a quantity was seen by then, and the two kinds of break.

    A null compares as in SQL, to no break.
    """
    first, _ = bounds(product)
    starts, group = np.flatnonzero(first), np.cumsum(first) - 1
    own = {n: v[product[starts]] for n, v in balance.items()}
    signed, before, after = rows["signed"], rows["stock_before"], rows["stock_after"]
    has_signed, has_before, has_after = (
        ~_absent(rows, n) for n in ("signed", "stock_before", "stock_after"))
    opening = np.where(own["known"], own["opening"], before[starts])
    level = opening[group] + _within(np.cumsum(signed), signed, starts, group)
    seen = has_signed.astype(np.int64)
    moved = own["moved"][group] | (_within(np.cumsum(seen), seen, starts, group) > 0)
    previous, follows = np.roll(after, 1), np.roll(has_after, 1)
    previous[starts], follows[starts] = own["previous"], own["follows"]
    wrong = has_signed & has_before & has_after & (after != before + signed)
    return level, moved, wrong, has_before & follows & (before != previous)


def _changes(rows: dict[str, np.ndarray], kinds: list[str], change: int) -> pd.DataFrame:
    shown = dict(rows, change=np.full(len(rows["time"]), change, np.int32))
    shown["kind"] = np.array([*kinds, None], object)[rows["kind"]]
    for name in _NULLABLE:
        shown[name] = nullable(rows[name], _absent(rows, name))
    return pd.DataFrame({n: shown[n] for n in _OUT.names})


def _folded(
    key: tuple[Any, ...], chunks: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Changes to the levels of a bucket's products."""
    new = pd.concat(list(chunks), ignore_index=True)
    old_kinds = state.get[2] if state.exists else []
    kinds = sorted({*old_kinds, *new["kind"].dropna().unique()})
    fresh = {c: new[c].to_numpy() for c in _FRESH}
    fresh["kind"] = pd.Categorical(new["kind"], categories=kinds).codes.astype(np.int32)
    fresh |= {"stock": np.zeros(len(new), np.int64), "wrong_sum": np.zeros(len(new), bool),
              "gap": np.zeros(len(new), bool)}
    if state.exists:
        folded, kept = (arrays(unpacked(s)) for s in state.get[:2])
        kept["kind"] = np.array([*map(kinds.index, old_kinds), -1], np.int32)[kept["kind"]]
    else:
        folded, kept = ({c: new["product_id"].to_numpy()[:0] for c in ["product_id", *_BALANCE]},
                        {c: fresh[c][:0] for c in _ROWS})
    rows = {c: joined(kept[c], fresh[c]) for c in _ROWS}
    is_new = np.arange(len(rows["time"])) >= len(kept["time"])

    # Balances by product; a product that is met for the first time may bring its opening.
    held = len(folded["product_id"])
    codes, products = pd.factorize(np.concatenate([folded["product_id"], rows["product_id"]]))
    balance = {n: np.zeros(len(products), t) for n, t in _BALANCE.items()}
    for name, values in balance.items():
        values[codes[:held]] = folded[name]
    product = codes[held:]
    opens = np.flatnonzero(~new[_NO_OPENING].to_numpy())[::-1]
    opens = opens[product[is_new][opens] >= held]
    balance["opening"][product[is_new][opens]] = new["opening"].to_numpy()[opens]
    for name in ("known", "moved"):
        balance[name][product[is_new][opens]] = True

    # In the ledger's order, nulls first; a kept movement stands before a new one like it.
    order = np.lexsort((rows["quantity"], ~_absent(rows, "quantity"), rows["kind"],
                        rows["movement_id"], ~_absent(rows, "movement_id"), rows["time"], product))
    rows, product, is_new = {c: v[order] for c, v in rows.items()}, product[order], is_new[order]
    level, moved, wrong, gap = _levels(rows, product, balance)
    no_stock = 1 << _NULLABLE.index("stock")
    given = {"stock": np.where(moved, level, 0), "wrong_sum": wrong, "gap": gap,
             _ABSENT: np.where(moved, rows[_ABSENT] & ~no_stock, rows[_ABSENT] | no_stock)}
    differs = np.logical_or.reduce([given[n] != rows[n] for n in given])
    back = differs & ~is_new
    now = rows | given
    if back.any():
        yield _changes({c: v[back] for c, v in rows.items()}, kinds, -1)
    if (differs | is_new).any():
        yield _changes({c: v[differs | is_new] for c, v in now.items()}, kinds, 1)

    # What the watermark has passed is the front of each product's rows.
    final = now["time"] <= state.getCurrentWatermarkMs() * 1000
    _, ends = bounds(product)
    ends[:-1] |= ~final[1:]
    ends &= final
    at = product[ends]
    balance["opening"][at], balance["known"][at] = level[ends], True
    balance["moved"][at] = moved[ends]
    balance["previous"][at] = now["stock_after"][ends]
    balance["follows"][at] = ~_absent(now, "stock_after")[ends]
    rest = {c: now[c][~final] for c in _ROWS}
    used = np.unique(rest["kind"][rest["kind"] >= 0])
    rest["kind"] = np.where(rest["kind"] < 0, -1, np.searchsorted(used, rest["kind"])).astype(np.int32)
    state.update((packed({"product_id": products, **balance}), packed(rest), [kinds[i] for i in used]))


def ledger_changes_stream(
    movements: DataFrame, lateness: str = "1 day", openings: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Stream: the ledger's rows with ``stock``, ``wrong_sum`` and ``gap``, as changes.

    A movement may arrive up to ``lateness`` behind the newest one; later ones
    are dropped by Spark, which counts them in the query's progress. ``openings`` (product_id, stock) are balances to start from,
    such as those at the end of an earlier ledger (``closing_balances``); without
    one a product starts from the ``stock_before`` of its first movement, or 0.
    Movements need a product and a time. ``settled`` adds the changes up.
    """
    kind = movements.schema["moved_at"].dataType
    instant = F.col("moved_at") if isinstance(kind, T.TimestampType) else wall_clock_time(F.col("moved_at"))
    absent = [F.lit(None).cast(_LONG).alias(c) for c in ("stock_before", "stock_after")
              if c not in movements.columns]
    rows = movements.select("*", *absent).select(
        F.col("product_id").cast(_LONG), instant.alias("_at"), F.unix_micros(instant).alias("time"),
        F.col("movement_id").cast(_LONG), "kind", F.col("quantity").cast(_LONG),
        signed_quantity().alias("signed"), F.col("stock_before").cast(_LONG),
        F.col("stock_after").cast(_LONG),
    ).where("product_id IS NOT NULL AND _at IS NOT NULL").withWatermark("_at", lateness)
    if openings is None:
        rows = rows.withColumn("opening", F.lit(None).cast(_LONG))
    else:
        known = openings.select("product_id", F.col("stock").cast(_LONG).alias("opening"))
        rows = rows.join(known, "product_id", "left")
    numbers = _NULLABLE[:-1]
    absent = [F.shiftleft(F.isnull(n).cast("int"), i) for i, n in enumerate(numbers)]
    dealt = rows.select(
        bucket_of("product_id", buckets), "product_id", "time", "kind",
        *(whole(rows, n) for n in numbers), reduce(Column.bitwiseOR, absent).alias(_ABSENT),
        whole(rows, "opening"), F.isnull("opening").alias(_NO_OPENING), "_at",
    )
    changes = dealt.groupBy(BUCKET).applyInPandasWithState(
        _folded, outputStructType=_OUT, stateStructType=_STATE, outputMode="append",
        # The timeout gives the watermark; no timer is ever set, as a product's rows may wait.
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    moved_at = F.timestamp_micros("time")
    if not isinstance(kind, T.TimestampType):
        moved_at = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, time / 1000000)")
    shown = [c for c in _OUT.names if c not in ("time", "signed")]
    return changes.withColumn("moved_at", moved_at.cast(kind)).select(*shown, "moved_at")


def settled(changes: DataFrame) -> DataFrame:
    """The rows that stand after all changes; a movement given twice stands twice."""
    columns = [c for c in changes.columns if c != "change"]
    sums = changes.groupBy(*columns).agg(F.sum("change").cast("int").alias("_n")).where("_n > 0")
    return sums.withColumn("_n", F.explode(F.expr("sequence(1, _n)"))).drop("_n")


def closing_balances(rows: DataFrame) -> DataFrame:
    """product_id and stock after the last of the given rows."""
    last = F.struct("moved_at", "movement_id", "kind", "quantity")
    return rows.groupBy("product_id").agg(F.max_by("stock", last).alias("stock"))
