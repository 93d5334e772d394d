"""Alerts when a stock level falls to its minimum.

An update raises an alert when the level before it was above the minimum and
the new one is not. Later readings below the minimum are silent, and so is a
key's first reading, which has no level before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stocklens.functions import labels as L
from stocklens.operators.keyed import HOT_ROWS, lag_by_key
from stocklens.streaming.buckets import (
    BUCKET,
    BUCKETS,
    NO_KEY,
    arrays,
    bounds,
    bucket_of,
    falls,
    joined,
    key_codes,
    nullable,
    packed,
    unpacked,
    whole,
)

# Columns of an update; ``level`` and ``min_level`` are numbers.
UPDATE_COLUMNS = ["product_id", "seq", "level", "min_level", "name"]


def alert_columns(level: Column) -> list[Column]:
    """The columns of an alert about a row that crosses."""
    high, medium = L.PRIORITIES[1], L.PRIORITIES[2]
    return [
        F.col("product_id"),
        F.col("seq"),
        level.alias("level"),
        F.lit(L.ALERT_LOW_STOCK).alias("kind"),
        F.format_string(L.MESSAGE_CROSSING, "name", level.cast("string")).alias("message"),
        F.when(level == 0, high).otherwise(medium).alias("priority"),
    ]


def crossing_alerts(updates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Batch: one alert per downward crossing."""
    reading = F.struct("level", "min_level")
    rows = updates.select(*UPDATE_COLUMNS).withColumn("_reading", reading)
    lagged = lag_by_key(rows, "product_id", ["seq"], "_reading", "_old", hot_rows)
    was_above = F.col("_old.level") > F.col("_old.min_level")
    is_below = F.col("level") <= F.col("min_level")
    return lagged.filter(was_above & is_below).select(*alert_columns(F.col("level")))


#: What is kept of a key, and of a reading besides.
_LAST = ["product_id", NO_KEY, "seq", "level", "min_level"]
_NO_SEQ = "_no_seq"


def _crossed(
    key: tuple[Any, ...], chunks: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Rows of a bucket's keys whose update crosses; the state is the last reading of each in sequence."""
    rows = pd.concat(list(chunks), ignore_index=True)
    last = arrays(unpacked(state.get[0])) if state.exists else {c: rows[c].to_numpy()[:0] for c in _LAST}
    held = len(last["seq"])
    ids, no_key, seq, level, least = (joined(last[c], rows[c].to_numpy()) for c in _LAST)
    no_seq = np.concatenate([np.zeros(held, bool), rows[_NO_SEQ].to_numpy()])
    codes = key_codes(ids, no_key)
    known, newest = np.zeros(codes.max() + 1, bool), np.zeros(codes.max() + 1, np.int64)
    known[codes[:held]], newest[codes[:held]] = True, seq[:held]
    taken = ~known[codes] | (~no_seq & (seq > newest[codes]))
    taken[:held] = True
    if (taken & no_seq).any():
        raise ValueError("a key's first readings need a sequence number")
    places = np.flatnonzero(taken)
    if len(places) == held:
        return
    places = places[np.lexsort((seq[places], codes[places]))]
    first, final = bounds(codes[places])
    crossed = places[falls(first, level[places], least[places])] - held
    kept = dict(zip(_LAST, (c[places[final]] for c in (ids, no_key, seq, level, least))))
    state.update((packed(kept),))
    if len(crossed):
        found = {c: rows[c].to_numpy()[crossed] for c in [NO_KEY, *UPDATE_COLUMNS]}
        found["product_id"] = nullable(found["product_id"], found[NO_KEY])
        yield pd.DataFrame({c: found[c] for c in UPDATE_COLUMNS})


def crossing_alerts_stream(updates: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Stream: the same alerts, with the last reading per key as state.

    Rows are put in sequence within a micro-batch. A row that comes in a later
    micro-batch than one with a higher ``seq`` of its key is late: it raises no
    alert and leaves the newer reading as it is. The keys lie in ``buckets``
    (see there); the rows of a bucket in one micro-batch are held by one task,
    so the source must bound its batches (``file_stream`` does).
    """
    slim = updates.select(
        "product_id", F.col("seq").cast("long"), F.col("level").cast("double"),
        F.col("min_level").cast("double"), "name",
    )
    dealt = slim.select(
        bucket_of("product_id", buckets), whole(slim, "product_id"), F.isnull("product_id").alias(NO_KEY),
        whole(slim, "seq"), F.isnull("seq").alias(_NO_SEQ), "level", "min_level", "name",
    )
    crossed = dealt.groupBy(BUCKET).applyInPandasWithState(
        _crossed,
        outputStructType=slim.schema,
        stateStructType=T.StructType([T.StructField("last", T.BinaryType())]),
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )
    level_type = updates.schema["level"].dataType
    return crossed.select(*alert_columns(F.col("level").cast(level_type)))
