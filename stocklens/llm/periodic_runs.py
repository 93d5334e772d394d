"""Operator 12: runs of repeated words, by string synchronising sets.

A run is a stretch of consecutive words with smallest period ``q`` and at least
two periods long that no neighbouring word extends. Texts are worked on where
they lie, many at a time, each with words of its own:

1. Names. Stretches of 1, 2, 4, ... words that occur more than once in their
   document get equal names if and only if they are equal, from the names of
   their halves. Most documents have no names beyond a few words and end there.
2. Periods below ``SMALL`` are found by comparing each word with that ``q``
   words on.
3. Scale ``t`` = 2, 4, 8, ... finds the periods from 3t to 6t. Its synchronising
   set holds the positions whose stretch of ``t`` words has the smallest hash
   among those that begin up to ``t`` words on, or whose end has; stretches with
   a period of t/3 or less do not count. Membership depends on the 2t words
   from a position only, so a run that is not locally periodic has the same
   members in each of its periods: two members with equal 2t words that lie 3t
   to 6t apart propose their distance. Every proposal is extended to both sides
   by names, which decides.
4. What the sets omit are runs of which a whole period is itself highly
   periodic. They stand where two runs of one smaller period and of equal
   roots meet; each such pair of runs proposes the distances at which they
   are in step.

A synchronising set has about one member in ``t`` words and a member has few
equals near by, so the work is about n log n, whatever repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.text import VISIBLE, Hasher, byte_rows, grams, mix

#: Periods below this are found word by word.
SMALL = 6
#: Least words of a run that is returned.
SHORTEST = 12
#: Periods that fit into a highly periodic stretch.
HIGHLY = 9
#: Words that are worked on together.
GROUP = 1 << 19

_SALT = np.uint64(0x9E3779B97F4A7C15)


def _spread(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(values.astype(np.uint64) * _SALT + np.uint64(salt))


class Names:
    """Names of the stretches of 1, 2, 4, ... words of a sequence; -1 where there is no equal."""

    def __init__(self, first: np.ndarray):
        self.levels = [_numbered(first, np.arange(len(first)))]
        while True:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            if 2 * step > len(last):
                break
            at = np.flatnonzero((last[:-step] >= 0) & (last[step:] >= 0))
            if not len(at):
                break
            pair = last[at].astype(np.int64) * (int(last.max()) + 1) + last[at + step]
            new = np.full(len(last), -1, np.int32)
            new[at] = _numbered(pair, at)
            if new.max(initial=-1) < 0:
                break
            self.levels.append(new)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on are equal."""
        n, done = len(self.levels[0]), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = np.minimum(i + done, n - 1), np.minimum(j + done, n - 1)
            name = self.levels[k]
            done += ((name[a] == name[b]) & (name[a] >= 0) & (j + done < n)).astype(np.int64) << k
        return done

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before ``i`` and before ``j`` are equal."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - done - (1 << k), j - done - (1 << k)
            name = self.levels[k]
            done += ((name[np.maximum(a, 0)] == name[np.maximum(b, 0)])
                     & (name[np.maximum(a, 0)] >= 0) & (a >= 0)).astype(np.int64) << k
        return done


def _numbered(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the values that occur more than once, -1 for the others."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[:len(ranked)]
    alone = new & np.append(new[1:], True)[:len(ranked)]
    out = np.empty(len(at), np.int32)
    out[order] = np.where(alone, -1, np.cumsum(new & ~alone) - 1)
    return out


class Runs:
    """The runs found so far: start, end and period."""

    def __init__(self) -> None:
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Keep what is long enough; of equal stretches that of the smallest period."""
        long = end - start >= 2 * period
        rows = np.stack([start[long], end[long], period[long]], axis=1)
        rows = np.concatenate([self.rows, rows])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        same = (rows[1:, :2] == rows[:-1, :2]).all(1)
        self.rows = rows[np.append(True, ~same)[:len(rows)]]

    def extend(self, names: Names, i: np.ndarray, period: np.ndarray) -> None:
        """Extend the equality of ``i`` and ``i + period`` to both sides."""
        if len(i):
            j = i + period
            self.add(i - names.back(i, j), j + names.ahead(i, j), period)


def _small_periods(words: np.ndarray, runs: Runs) -> None:
    for q in range(1, min(SMALL, len(words))):
        same = np.zeros(len(words) - q + 2, np.int8)
        same[1:-1] = (words[q:] == words[:-q]) & (words[q:] >= 0)
        edges = np.flatnonzero(np.diff(same))
        start, end = edges[::2], edges[1::2] + q
        runs.add(start, end, np.full(len(start), q))


def _highly_periodic(runs: Runs, t: int, n: int) -> np.ndarray:
    """Positions whose stretch of ``t`` words has a period of a third or less."""
    start, end, period = runs.rows.T
    fits = (3 * period <= t) & (end - start >= t)
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, start[fits], 1)
    np.add.at(steps, end[fits] - t + 1, -1)
    return np.cumsum(steps[:n]) > 0


def _least_within(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each stretch of ``width`` values; beyond the end there are none."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def synchronising_set(names: Names, level: int, runs: Runs) -> np.ndarray:
    """Members whose 2t words, t = 2**level, occur elsewhere too; names exist at ``level + 1``."""
    t, none = 1 << level, np.uint64(0xFFFFFFFFFFFFFFFF)
    short = names.levels[level]
    n = len(short)
    ids = np.where(short >= 0, _spread(short, 2 * level), _spread(np.arange(n), 2 * level + 1))
    ids = np.minimum(ids, none - np.uint64(1))
    ids[_highly_periodic(runs, t, n)] = none
    at = np.flatnonzero(names.levels[level + 1] >= 0)
    least = _least_within(ids, t + 1)[at]
    return at[(least != none) & ((least == ids[at]) | (least == ids[at + t]))]


def _pairs_of_scale(names: Names, level: int, runs: Runs) -> None:
    t = 1 << level
    at = synchronising_set(names, level, runs)
    context = names.levels[level + 1][at]
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    some = np.arange(len(at))
    found, step = [], 1
    while len(some):
        some = some[some + step < len(at)]
        apart = at[some + step] - at[some]
        near = (context[some + step] == context[some]) & (apart < 6 * t)
        some, apart = some[near], apart[near]
        found.append(np.stack([at[some], apart], axis=1)[apart >= 3 * t])
        step += 1
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    runs.extend(names, pairs[:, 0], pairs[:, 1])


def _first_root(words: np.ndarray, start: int, period: int) -> tuple[int, int]:
    """Place of the root of smallest hash among the first ones of a run, and that hash."""
    hashes = grams(words[start:start + 2 * period - 1].astype(np.uint64), period)
    least = int(np.argmin(hashes))
    return start + least, int(hashes[least])


def _meeting_runs(words: np.ndarray, names: Names, runs: Runs) -> None:
    """Runs whose periods are highly periodic themselves, from pairs of runs in step."""
    rows = runs.rows[(runs.rows[:, 1] - runs.rows[:, 0] >= HIGHLY * runs.rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2]))]
    left, right = rows[:-1], rows[1:]
    meet = (left[:, 2] == right[:, 2]) & (right[:, 0] <= left[:, 1])
    found_i, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (s1, e1, p), (s2, e2, _) in zip(left[meet].tolist(), right[meet].tolist()):
        (a1, hash1), (a2, hash2) = _first_root(words, s1, p), _first_root(words, s2, p)
        if hash1 != hash2:
            continue
        most = min(e1 - s1, e2 - s2, (e2 - s1) // 2)
        q = np.arange((a2 - a1) % p, most + 1, p)
        q = q[q > p]
        found_q.append(q)
        found_i.append(np.maximum(s1, s2 - q))
    runs.extend(names, np.concatenate(found_i), np.concatenate(found_q))


def find_runs(words: np.ndarray) -> np.ndarray:
    """All runs of at least two periods of a sequence of numbers: rows of start, end and period.

    Equal numbers are equal words; numbers below 0 are equal to nothing.
    """
    names, runs = Names(words), Runs()
    if len(words):
        first = names.levels[0]
        _small_periods(first, runs)
        for level in range(1, len(names.levels) - 1):
            _pairs_of_scale(names, level, runs)
        _meeting_runs(first, names, runs)
    return runs.rows


def _sequence(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts as numbers that no two texts share, and the words' bounds.

    A word that is nowhere else ends each text, so that nothing goes on into the next.
    """
    hasher, parts, counts = Hasher(VISIBLE, lower=False), [], []
    for i, words in enumerate(map(hasher.words, texts)):
        own = words ^ mix(np.array([i + 1], np.uint64))
        parts += [own, mix(np.array([i + 1], np.uint64) + _SALT)]
        counts.append(len(words) + 1)
    return np.concatenate(parts), np.append(0, np.cumsum(counts))


def text_runs(texts: list[np.ndarray], shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each text its runs of at least ``shortest`` words: start, length, period, by start."""
    numbers, bounds = _sequence(texts)
    rows = find_runs(numbers.view(np.int64))
    rows = rows[rows[:, 1] - rows[:, 0] >= shortest]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    of = np.searchsorted(bounds, rows[:, 0], "right") - 1
    rows = np.stack([rows[:, 0] - bounds[of], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    return np.split(rows, np.searchsorted(of, np.arange(1, len(texts))))


def _groups(column: pa.Array) -> Iterator[list[np.ndarray]]:
    group, size = [], 0
    for text in byte_rows(column):
        if group and size + len(text) > 6 * GROUP:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = ("doc_id long, n_words long, "
           "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _collapsed(text: np.ndarray, runs: np.ndarray) -> tuple[int, bytes]:
    words = text.tobytes().split()
    if len(runs):
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
        gone = np.cumsum(drop[:-1]) > 0
        return len(words), b" ".join([w for w, d in zip(words, gone.tolist()) if not d])
    return len(words), b" ".join(words)


def _found(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in _groups(batch.column(1)):
                runs = text_runs(texts, shortest)
                kept = [_collapsed(t, r) for t, r in zip(texts, runs)]
                every = np.concatenate([np.zeros((0, 3), np.int64), *runs])
                lists = pa.ListArray.from_arrays(
                    np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32),
                    pa.StructArray.from_arrays(
                        [pa.array(np.ascontiguousarray(c)) for c in every.T], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array([n for n, _ in kept]),
                     lists, pa.array([k.decode() for _, k in kept], pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])
                first += len(texts)

    return run


def periodic_runs(
    docs: DataFrame, shortest: int = SHORTEST, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed text of every row.

    Words are what white space separates. A run is a stretch of words with
    smallest period q and length of at least 2 * q and ``shortest`` that no
    neighbouring word extends; runs come by start, then period. ``collapsed`` is
    the text, words joined by one space, without the words that a run holds after
    its first q. A null, empty or wordless text has no words and no runs, and
    collapses to an empty text. Rows with equal or null ids stay separate, a text
    of any length is worked on whole, an empty table gives an empty one, and other
    columns are not kept. Words are known by 64 hash bits.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return texts.mapInArrow(_found(shortest), _SCHEMA)


def with_periodic_tails(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts with their last words replaced by repeats of some of them.

    With h the crc32 of the decimal id and g = floor(h / 10), a text of n > 0 words
    is changed where h % 10 = 0: from word a = g % n on, the p words from there
    are repeated, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    whole = lambda c: c.cast("int")
    root = F.slice(words, whole(a) + 1, whole(p))
    times = whole(F.ceil((n - a) / p))
    tail = F.slice(F.flatten(F.array_repeat(root, times)), F.lit(1), whole(n - a))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), whole(a)), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


def longest() -> Column:
    """The longest run of ``runs``, the first of equals and the one of smaller period; null for none."""
    ranked = F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("faster")))
    return F.array_max(ranked)
