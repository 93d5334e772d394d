"""State of many keys in one group of a stream.

A Python function that is called per key costs milliseconds a call, however few
rows the key has, and a micro-batch may touch hundreds of thousands of keys.
Here the keys are dealt to a fixed number of buckets by their hash. The function
is called per bucket, works on all of its keys at once, and its state holds
theirs as columns: a few bytes a key.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A checkpoint belongs to the number it was made with.
BUCKETS = 128
BUCKET, NO_KEY = "_bucket", "_no_key"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def whole(df: DataFrame, column: str) -> Column:
    """A column without nulls if it holds whole numbers: a data frame would make floats of them."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType):
        return F.col(column)
    return F.coalesce(F.col(column), F.lit(0).cast(kind)).alias(column)


def packed(columns: Mapping[str, np.ndarray | pa.Array] | pa.Table) -> bytes:
    """Columns of one length as bytes."""
    table = columns if isinstance(columns, pa.Table) else pa.table(dict(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(state: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(state)).read_all()


def arrays(table: pa.Table) -> dict[str, np.ndarray]:
    return {n: table[n].to_numpy() for n in table.column_names}


def joined(*parts: np.ndarray) -> np.ndarray:
    """Arrays one after another; an empty one does not set the type."""
    return np.concatenate([p for p in parts if len(p)] or parts[:1])


def key_codes(keys: np.ndarray, no_key: np.ndarray) -> np.ndarray:
    """A number per key, 0 for the rows without one."""
    return np.where(no_key, 0, pd.factorize(keys, use_na_sentinel=False)[0] + 1)


def bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first and the last of their key, among rows sorted by key."""
    turns = np.flatnonzero(codes[1:] != codes[:-1])
    first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    first[:1], last[-1:] = True, True
    first[turns + 1], last[turns] = True, True
    return first, last


def falls(first: np.ndarray, level: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows reach their minimum from above it, among the sorted rows of keys."""
    found = np.zeros(len(level), bool)
    found[1:] = ~first[1:] & (level[:-1] > least[:-1]) & (level[1:] <= least[1:])
    return found


def nullable(values: np.ndarray, absent: np.ndarray) -> pd.Series:
    """Values with their nulls, whole numbers exactly."""
    return pd.Series(np.where(absent, None, values.astype(object)) if absent.any() else values)
