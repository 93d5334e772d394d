"""Words of UTF-8 texts as numpy arrays, for use inside Arrow tasks.

A word is a run of bytes of one class; all bytes of a character beyond ASCII
count as word bytes, so classes that name ASCII characters only can be told
from bytes. Words are compared through 64-bit hashes that do not depend on
the word's place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower case.
LETTERS = np.array(
    [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
)
#: Word bytes of ``[^\x20\x09-\x0D]+``.
VISIBLE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

#: Bytes that are hashed in one go; longer texts are cut at word ends.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of the words of a text; one per task, since it keeps its tables."""

    def __init__(self, word_bytes: np.ndarray, lower: bool):
        self.word_bytes, self.values = word_bytes, _VALUES[lower]
        self._grow(PIECE)

    def _grow(self, n: int) -> None:
        self.powers, self.inverse = _powers(_BASE, n), _powers(_INVERSE, n)

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each word and the byte after it."""
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = self.word_bytes[data]
        edges = np.flatnonzero(np.diff(inside))
        return edges[::2], edges[1::2]

    def words(self, data: np.ndarray) -> np.ndarray:
        """The words' hashes in order."""
        starts, ends = self.spans(data)
        return self.hashes(data, starts, ends)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the given spans."""
        out, first = [], 0
        while first < len(starts):
            base = int(starts[first])
            last = max(first + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            a, b = starts[first:last] - base, ends[first:last] - base
            n = int(b[-1])
            if n > len(self.powers):
                self._grow(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.values[data[base:base + n]] * self.powers[:n], out=sums[1:])
            out.append(mix((sums[b] - sums[a]) * self.inverse[a] + (b - a).astype(np.uint64)))
            first = last
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words: sums of runs of doubled length, put together."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Both sums are of runs that begin at each place; ``total`` is of ``done`` words.
    total, done, double, length = None, 0, words, 1
    while True:
        if k & length:
            if total is None:
                total = double
            else:
                total = total[:len(words) - done - length + 1] * _power(length) + double[done:]
            done += length
        if done == k:
            return mix(total[:n])
        double = double[:-length] * _power(length) + double[length:]
        length *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted; for hashes quicker than numpy's own."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]


def whole(words: np.ndarray) -> np.uint64:
    """One hash of a short sequence, other than that of any run of it."""
    return mix(grams(words, len(words)) + np.uint64(len(words)))[0]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value of each window, the last of equals."""
    best, place, length = values, np.arange(len(values)), 1
    while length < width:
        step = min(length, width - length)
        later = best[step:] <= best[:-step]
        place = np.where(later, place[step:], place[:-step])
        best = np.minimum(best[step:], best[:-step])
        length += step
    return place


def covered(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window that begins at one of ``starts``; widths may differ."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text; none for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(n):
        yield data[bounds[i]:bounds[i + 1]] if valid[i] else data[:0]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch with a line end after each, and where each begins; none for null."""
    texts = [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), starts


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column with one row per array."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(offsets, pa.array(values).cast(kind))
