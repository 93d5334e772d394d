"""Bit tables of hashes: a bounded test that lets no wanted row go.

A table has a fixed number of bits, whatever the number of hashes. A row whose
bit is not set is surely not among them; others may pass by chance, the more
the fuller the table, so what follows must not rely on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a hash that choose its place (8 MB in all), and bytes of a slice.
PLACE_BITS, SLICE = 26, 1 << 16


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def _own(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).drop_null().to_numpy().view(np.uint64)


def _marked(hashes_of: Callable[[pa.RecordBatch], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << PLACE_BITS) // 8, np.uint8)
        for batch in batches:
            places = _places(hashes_of(batch))
            np.bitwise_or.at(table, places >> 3, np.uint8(128) >> (places & 7).astype(np.uint8))
        slices = table.reshape(-1, SLICE)
        used = np.flatnonzero(slices.any(1))
        for i in used:
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([slices[i].tobytes()], pa.binary())],
                ["slice", "bits"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
            total = totals.setdefault(number, np.zeros(SLICE, np.uint8))
            total |= np.frombuffer(bits.as_buffer(), np.uint8)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.int32()),
         pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["slice", "bits"])


def bit_table(
    rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray] = _own,
) -> np.ndarray:
    """The table of the hashes that ``hashes_of`` takes from a batch of rows.

    Without it they are the frame's only column, 64-bit hashes; nulls are left
    out. A Python step before this one would take a second worker for each task.
    """
    schema = "slice int, bits binary"
    slices = rows.mapInArrow(_marked(hashes_of), schema).repartition("slice").mapInArrow(
        _merged, schema)
    table = np.zeros((1 << PLACE_BITS) // 8, np.uint8).reshape(-1, SLICE)
    for row in slices.toLocalIterator():
        table[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for hashes that the table surely lacks."""
    places = _places(hashes)
    return (table[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 > 0
