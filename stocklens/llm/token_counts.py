"""Operator 11: token counts by a two-tier lookup of pre-token lengths.

A text is cut into pre-tokens, pieces from where the vocabulary's merges never
reach back, so its number of tokens is the sum of its pre-tokens' numbers:

1. Every task counts its pre-tokens in a summary of bounded size (Misra-Gries:
   a pre-token that holds more than one in ``SUMMARY`` of all cannot be
   missing). Tasks send one summary each; these are folded in a tree by task
   number. No pre-token is ever a key of a shuffle.
2. The most frequent pre-tokens are encoded once and broadcast as a compact
   hash table of their lengths in tokens (tier one, of fixed size).
3. Texts are looked up where they lie. Pre-tokens that the table lacks go to a
   cache that a Python worker keeps from task to task (tier two, bounded), and
   through the tokenizer only if that lacks them too.

The tiers only save work. What they hold has no influence on the counts.
Pre-tokens are known by 64 hash bits.
"""

from __future__ import annotations

import functools
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.text import VISIBLE, Hasher, byte_rows
from stocklens.llm.token_files import cuts, gather

#: Pre-tokens of the broadcast table, and of a summary.
FREQUENT, SUMMARY = 1 << 16, 1 << 15
#: Longest pre-token of a summary, in bytes.
LONGEST = 64
#: Pre-tokens that a worker's cache holds before it starts anew.
CACHED = 1 << 20
#: Bytes of text that are looked up together.
GROUP = 2 << 20
#: Tokens beyond which a document is over the limit.
LIMIT = 1024


class Lengths:
    """An open-addressing hash table from 64-bit keys to whole numbers."""

    def __init__(self, room: int = 1 << 10):
        self.n = 0
        self._make(1 << max(4, math.ceil(math.log2(2 * max(1, room)))))

    def _make(self, slots: int) -> None:
        self.keys, self.values = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.mask, self.shift = slots - 1, np.uint64(64 - int(math.log2(slots)))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 for keys that the table lacks."""
        keys = np.maximum(keys, np.uint64(1))  # 0 marks a free slot
        slots = self._home(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in different keys that the table lacks."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            used = self.keys != 0
            old, held = self.keys[used], self.values[used]
            self._make(1 << math.ceil(math.log2(4 * (self.n + len(keys)))))
            self._place(old, held)
        self._place(np.maximum(keys, np.uint64(1)), values)
        self.n += len(keys)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        slots, left = self._home(keys), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several that want a slot one gets it
            got = self.keys[at] == keys[left]
            self.values[at[got]] = values[left[got]]
            left = left[~got]
            slots[left] = (slots[left] + 1) & self.mask


class Summary:
    """Counts of the most frequent pre-tokens with their bytes, at most ``room`` of them.

    Counts are too small by at most the pre-tokens seen over ``room``.
    """

    def __init__(self, room: int):
        self.room = room
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def add(self, keys: np.ndarray, counts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> None:
        """Count more; the keys are sorted and different, ``data`` holds their bytes in order."""
        keys = np.concatenate([self.keys, keys])
        counts = np.concatenate([self.counts, counts])
        sizes = np.concatenate([self.sizes, sizes])
        data = np.concatenate([self.bytes, data])
        self.keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        self.counts = np.zeros(len(self.keys), np.int64)
        np.add.at(self.counts, which, counts)
        self._keep(first, sizes, data)
        if len(self.keys) > 2 * self.room:
            self.trim()

    def _keep(self, at: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> None:
        self.bytes = gather(data, (np.cumsum(sizes) - sizes)[at], sizes[at])
        self.sizes = sizes[at]

    def trim(self) -> None:
        """Take the count of the first one left out off all counts."""
        if len(self.keys) <= self.room:
            return
        counts = self.counts - np.partition(self.counts, -self.room - 1)[-self.room - 1]
        at = np.flatnonzero(counts > 0)
        self.keys, self.counts = self.keys[at], counts[at]
        self._keep(at, self.sizes, self.bytes)

    def row(self, part: int) -> pa.RecordBatch:
        self.trim()
        columns = (self.keys, self.counts, self.sizes.astype(np.uint8), self.bytes)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
            ["part", "keys", "counts", "sizes", "bytes"])

    def fold(self, keys: bytes, counts: bytes, sizes: bytes, data: bytes) -> None:
        """Add what another summary's row holds."""
        self.add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64),
                 np.frombuffer(sizes, np.uint8).astype(np.int64), np.frombuffer(data, np.uint8))


_ROW = "part int, keys binary, counts binary, sizes binary, bytes binary"


def _groups(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """A column's texts in order, in groups of bounded size; a longer text is one group."""
    group, size = [], 0
    for text in byte_rows(column):
        if group and size + len(text) > GROUP:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _pieces(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, first and last bytes of the pre-tokens, and the number of each text's."""
    data = np.concatenate([np.zeros(0, np.uint8), *texts])
    sizes = np.array([len(t) for t in texts], np.int64)
    ends_of_texts = np.cumsum(sizes)
    starts = cuts(data, (ends_of_texts - sizes)[sizes > 0])
    ends = np.append(starts[1:], len(data))[:len(starts)]
    return data, starts, ends, np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, summary = Hasher(VISIBLE, lower=False), Summary(SUMMARY)
    for batch in batches:
        for texts in _groups(batch.column(0)):
            data, starts, ends, _ = _pieces(texts)
            short = np.flatnonzero(ends - starts <= LONGEST)
            starts, ends = starts[short], ends[short]
            keys, first, counts = np.unique(
                hasher.hashes(data, starts, ends), return_index=True, return_counts=True)
            sizes = (ends - starts)[first]
            summary.add(keys, counts, sizes, gather(data, starts[first], sizes))
    yield summary.row(TaskContext.get().partitionId())


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    summary, part = Summary(SUMMARY), None
    for batch in batches:
        for number, *columns in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            part = number
            summary.fold(*(c.as_buffer() for c in columns))
    if part is not None:
        yield summary.row(part)


@functools.cache
def _tokenizer(file: str):
    # Tasks already run side by side; the library's own threads would add to them.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def _encoded(file: str, pieces: list[str]) -> np.ndarray:
    found = _tokenizer(file).encode_batch_fast(pieces, add_special_tokens=False)
    return np.array([len(x.ids) for x in found], np.int32)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The given stretches of UTF-8 bytes as strings."""
    raw = gather(data, starts, ends - starts).tobytes()
    bounds = np.append(0, np.cumsum(ends - starts)).tolist()
    return [raw[a:b].decode(errors="replace") for a, b in zip(bounds[:-1], bounds[1:])]


def frequent_lengths(texts: DataFrame, file: str, most: int = FREQUENT) -> Lengths:
    """Tier one: lengths of the frequent pre-tokens of a frame's only column, over all rows.

    A task sends a summary of at most ``SUMMARY`` pre-tokens. About the square
    root of all summaries are folded together, and the driver folds the rest one
    by one.
    """
    rows = texts.mapInArrow(_summarise, _ROW)
    folded = rows.repartition(F.floor(F.sqrt("part"))).mapInArrow(_fold, _ROW)
    total = Summary(most)
    for row in folded.toLocalIterator():
        total.fold(*row[1:])
    total.trim()
    ends = np.cumsum(total.sizes)
    table = Lengths(len(total.keys))
    table.add(total.keys, _encoded(file, _strings(total.bytes, ends - total.sizes, ends)))
    return table


_CACHES: dict[str, Lengths] = {}


def worker_cache(file: str, most: int) -> Lengths:
    """Tier two of this Python worker, empty again once it is full."""
    if file not in _CACHES or _CACHES[file].n > most:
        _CACHES[file] = Lengths()
    return _CACHES[file]


def piece_lengths(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher,
    table: Lengths, file: str, most: int = CACHED,
) -> np.ndarray:
    """Tokens of each pre-token, from the table, the worker's cache or the tokenizer."""
    keys = hasher.hashes(data, starts, ends)
    out = table.get(keys)
    missing = np.flatnonzero(out < 0)
    if not len(missing):
        return out
    cache = worker_cache(file, most)
    new, first, which = np.unique(keys[missing], return_index=True, return_inverse=True)
    known = cache.get(new)
    unmet = np.flatnonzero(known < 0)
    at = missing[first[unmet]]
    known[unmet] = _encoded(file, _strings(data, starts[at], ends[at]))
    cache.add(new[unmet], known[unmet])
    out[missing] = known[which]
    return out


def _counted(shared, file: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(VISIBLE, lower=False), shared.value
        for batch in batches:
            counts = [np.zeros(0, np.int64)]
            for texts in _groups(batch.column(2)):
                data, starts, ends, pieces = _pieces(texts)
                lengths = piece_lengths(data, starts, ends, hasher, table, file, most)
                upto = np.append(0, np.cumsum(lengths, dtype=np.int64))
                counts.append(np.diff(upto[np.append(0, np.cumsum(pieces))]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(np.concatenate(counts))],
                ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame, file: str, limit: int = LIMIT, most_frequent: int = FREQUENT,
    most_cached: int = CACHED, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row.

    Counts are those of the tokenizers library for the byte-level BPE ``file`` on
    whole texts: no special tokens are added, one that a text spells out is one
    token, nothing is cut or padded. A null text is empty: no bytes, no tokens.
    Rows with equal or null ids stay separate, a very long text is looked up by
    itself, an empty table gives an empty one, and other columns are not kept.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    table = frequent_lengths(docs.select(text), file, most_frequent)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    counted = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"),
    ).mapInArrow(_counted(shared, file, most_cached), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
