"""T1 in any order: alerts from readings that arrive late, released by event time.

``crossings.crossing_alerts_stream`` takes readings as they come, so one that
arrives after a newer one of its key raises no alert. Here each key keeps the
readings that may still be overtaken, and puts them in order before it looks
for a crossing: a reading is released once the watermark has passed its time,
which is when Spark no longer lets an earlier one through. A key holds the
readings of about the lateness, not its history. The keys lie in ``buckets``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

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
from stocklens.streaming.crossings import UPDATE_COLUMNS, alert_columns

#: Columns of a reading that waits: its key, its time in ms, and what an alert needs.
_WAITING = ["product_id", "time", "seq", "_no_seq", "level", "min_level", "name"]
_LAST = ["product_id", "level", "min_level"]
#: Of the keys of a bucket: the last reading released, and the readings that wait; null for none.
_STATE = T.StructType([T.StructField("last", T.BinaryType()), T.StructField("waiting", T.BinaryType())])


def wall_clock_time(column: Column) -> Column:
    """A wall-clock time as an instant, read as UTC whatever the session's zone.

    A watermark needs an instant; ``TIMESTAMP_NTZ`` is refused.
    """
    return F.concat(column.cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")


def _alerts(ready: dict[str, np.ndarray], last: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
    """Which of the readings cross, as their places in order, and the last reading of each key after them."""
    held, count = len(last["level"]), len(ready["level"])
    fresh = np.arange(held + count) >= held
    ids, level, least = (joined(last[c], ready[c]) for c in _LAST)
    time, seq, no_seq = (np.concatenate([np.zeros(held, ready[c].dtype), ready[c]])
                         for c in ("time", "seq", "_no_seq"))
    codes = key_codes(ids, np.zeros(len(ids), bool))
    order = np.lexsort((seq, no_seq, time, fresh, codes))
    first, final = bounds(codes[order])
    crossed = order[falls(first, level[order], least[order])] - held
    return crossed, dict(zip(_LAST, (c[order[final]] for c in (ids, level, least))))


def _released(
    key: tuple[Any, ...], chunks: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Alerts among the readings of a bucket's keys that the watermark has passed."""
    last, waiting = state.get if state.exists else (None, None)
    parts = [] if waiting is None else [unpacked(waiting)]
    for chunk in chunks:
        keyed = chunk.loc[~chunk[NO_KEY].to_numpy(), _WAITING]
        if len(keyed):
            parts.append(pa.Table.from_pandas(keyed, preserve_index=False).replace_schema_metadata(None))
    if not parts:
        return
    # The names of a part may all be null, which leaves its column without a type.
    rows = pa.concat_tables(parts, promote_options="permissive")
    time = rows["time"].to_numpy()
    passed = time <= state.getCurrentWatermarkMs()
    if passed.any():
        ready = arrays(rows.filter(pa.array(passed)))
        was = arrays(unpacked(last)) if last is not None else {c: ready[c][:0] for c in _LAST}
        crossed, newest = _alerts(ready, was)
        last = packed(newest)
        if len(crossed):
            found = {c: ready[c][crossed] for c in ready}
            found["seq"] = nullable(found["seq"], found["_no_seq"])
            yield pd.DataFrame({c: found[c] for c in UPDATE_COLUMNS})
    rest = rows.filter(pa.array(~passed))
    state.update((last, packed(rest.combine_chunks()) if len(rest) else None))
    if len(rest):
        state.setTimeoutTimestamp(int(time[~passed].min()))


def reordered_alerts_stream(
    updates: DataFrame, time: str = "ts", lateness: str = "1 hour", buckets: int = BUCKETS
) -> DataFrame:
    """Stream: the alerts of ``crossings.crossing_alerts``, whatever the order of arrival.

    ``updates`` has the columns of an update and ``time``, a timestamp that does
    not fall as ``seq`` rises; readings of one time go by ``seq``. A reading that
    arrives with its time more than ``lateness`` behind the newest one is dropped
    by Spark, which counts it in the query's progress (``numRowsDroppedByWatermark``).
    An alert comes out once the newest reading of any key is that far ahead, so
    the last ones need a later reading, or a row without a key whose time closes
    the stream. A reading without a time raises no alert.
    """
    kind = updates.schema[time].dataType
    instant = F.col(time) if isinstance(kind, T.TimestampType) else wall_clock_time(F.col(time))
    slim = updates.select(
        "product_id", F.col("seq").cast("long"), F.col("level").cast("double"),
        F.col("min_level").cast("double"), F.col("name").cast("string"), instant.alias("_at"),
    ).where("_at IS NOT NULL").withWatermark("_at", lateness)
    out = T.StructType([f for f in slim.schema.fields if f.name in UPDATE_COLUMNS])
    dealt = slim.select(
        bucket_of("product_id", buckets), whole(slim, "product_id"), F.isnull("product_id").alias(NO_KEY),
        F.unix_millis("_at").alias("time"), whole(slim, "seq"), F.isnull("seq").alias("_no_seq"),
        "level", "min_level", "name", "_at",
    )
    found = dealt.groupBy(BUCKET).applyInPandasWithState(
        _released, outputStructType=out, stateStructType=_STATE, outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(*alert_columns(F.col("level").cast(updates.schema["level"].dataType)))
