"""k-means from many starts at once.

Starts do not depend on each other, so they share every pass over the data: the
centres of all of them are broadcast together (starts x k vectors), each task
assigns its rows for every start, and one aggregation gives the sums of all. A
fit takes as many passes as its slowest start, not as all starts together.

Seeding is k-means||, also for all starts in the same passes: rows are drawn
with a chance in proportion to their distance from what was drawn before, a few
rounds of about ``2 k`` rows each, and a weighted k-means++ on these gives the
first centres. Chances are compared with a hash of the row's key, so a task that
is run again draws the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of seeding, rounds of improvement at most, and the move below which a start is done.
SEED_ROUNDS, MOST_ROUNDS, TOLERANCE = 3, 300, 1e-4
#: Distances that a task holds at a time.
CELLS = 1 << 21


@dataclass(frozen=True)
class Fit:
    """Centres of the cheapest start, its cost, the cost of every start, and the rounds of the slowest."""

    centres: np.ndarray
    cost: float
    costs: list[float]
    rounds: int

    def assign(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """The number of each row's nearest centre, by a column expression."""
        x = vector_to_array(features)
        distances = [
            F.aggregate(
                F.zip_with(x, F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) * (a - b)),
                F.lit(0.0), lambda total, d: total + d)
            for c in self.centres]
        nearest = F.array_min(F.array(*[
            F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(distances)]))
        return df.withColumn(out, nearest["i"])


def _blocks(batches: Iterator[pa.RecordBatch], per_row: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Vectors of some rows as a matrix, with the rows; so many that their distances fit."""
    step = max(1, CELLS // max(1, per_row))
    for batch in batches:
        for first in range(0, len(batch), step):
            part = batch.slice(first, step)
            lists = part.column(0)
            values = np.asarray(lists.flatten(), float)
            yield values.reshape(len(part), -1), part


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres."""
    cross = x @ centres.T
    both = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None]
    return np.maximum(both - 2 * cross, 0)


def _summed(shared) -> Callable:
    """Rows, costs and sums of vectors of each start's clusters, over a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        sizes = [len(c) for c in starts]
        first = np.append(0, np.cumsum(sizes))
        every = np.concatenate(starts)
        n, d = every.shape
        counts, costs, sums = np.zeros(n, np.int64), np.zeros(n), np.zeros((n, d))
        for x, _ in _blocks(batches, n):
            distances = _squared(x, every)
            for a, b in zip(first[:-1], first[1:]):
                own = distances[:, a:b]
                nearest = own.argmin(1)
                counts[a:b] += np.bincount(nearest, minlength=b - a)
                costs[a:b] += np.bincount(nearest, own[np.arange(len(x)), nearest], b - a)
                for j in range(d):
                    sums[a:b, j] += np.bincount(nearest, x[:, j], b - a)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()),
             pa.array(np.concatenate([np.arange(s) for s in sizes]), pa.int32()),
             pa.array(counts), pa.array(costs),
             *(pa.array(np.ascontiguousarray(sums[:, j])) for j in range(d))],
            ["start", "cluster", "n", "cost", *(f"x{j}" for j in range(d))])

    return run


def _totals(vectors: DataFrame, starts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each start the rows, costs and sums of its clusters, in one pass."""
    d = starts[0].shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(starts)
    columns = ", ".join(f"x{j} double" for j in range(d))
    parts = vectors.select("x").mapInArrow(
        _summed(shared), f"start int, cluster int, n long, cost double, {columns}")
    sums = parts.groupBy("start", "cluster").agg(
        *[F.sum(c).alias(c) for c in ("n", "cost", *(f"x{j}" for j in range(d)))]).collect()
    out = [(np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros(c.shape)) for c in starts]
    for start, cluster, n, cost, *x in sums:
        for target, value in zip(out[start], (n, cost, x)):
            target[cluster] = value
    return out


def _drawn(shared, seed: int) -> Callable:
    """Rows drawn for each start, by the distance from what it drew before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, factors = shared.value
        for x, part in _blocks(batches, sum(map(len, starts))):
            keys = part.column(1).to_numpy().view(np.uint64)
            for start, (centres, factor) in enumerate(zip(starts, factors)):
                chance = factor * _squared(x, centres).min(1)
                salt = np.random.default_rng([seed, start]).integers(1, 1 << 63, 2, np.uint64) | np.uint64(1)
                mixed = keys * salt[0]
                mixed = (mixed ^ (mixed >> np.uint64(31))) * salt[1]
                at = np.flatnonzero((mixed >> np.uint64(11)) / float(1 << 53) < chance)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), start), pa.int32()), part.column(0).take(pa.array(at))],
                        ["start", "x"])

    return run


def _plus_plus(rows: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of a few weighted rows, far from each other."""
    centres = rows[[rng.choice(len(rows), p=weights / weights.sum())]]
    while len(centres) < k:
        mass = weights * _squared(rows, centres).min(1)
        if mass.sum() <= 0:
            mass = np.ones(len(rows))
        centres = np.append(centres, rows[[rng.choice(len(rows), p=mass / mass.sum())]], axis=0)
    return centres


def _seeds(vectors: DataFrame, k: int, starts: int, seed: int) -> list[np.ndarray]:
    spark = vectors.sparkSession
    first = vectors.orderBy(F.xxhash64(F.lit(seed), "key")).limit(starts).collect()
    drawn = [np.array([first[i % len(first)]["x"]], float) for i in range(starts)]
    for number in range(SEED_ROUNDS):
        costs = [cost.sum() for _, cost, _ in _totals(vectors, drawn)]
        factors = [2 * k / c if c > 0 else 0.0 for c in costs]
        shared = spark.sparkContext.broadcast((drawn, factors))
        rows = vectors.select("x", "key").mapInArrow(
            _drawn(shared, seed * 1000 + number), "start int, x array<double>").collect()
        for start in range(starts):
            new = [r["x"] for r in rows if r["start"] == start]
            if new:
                drawn[start] = np.unique(np.concatenate([drawn[start], np.array(new)]), axis=0)
    weights = [n for n, _, _ in _totals(vectors, drawn)]
    return [_plus_plus(rows, w.astype(float), k, np.random.default_rng([seed, i]))
            for i, (rows, w) in enumerate(zip(drawn, weights))]


def fit_starts(
    df: DataFrame, key: str, features: str, k: int, starts: int, seed: int = 42,
    most_rounds: int = MOST_ROUNDS,
) -> Fit:
    """The cheapest of several k-means fits, all made in the same passes.

    ``features`` is a vector column without nulls, ``key`` tells rows apart. A
    cluster that loses all rows keeps its centre. Needs at least one row.
    """
    vectors = df.select(vector_to_array(features).alias("x"), F.xxhash64(key).alias("key"))
    centres = _seeds(vectors, k, starts, seed)
    moving, rounds = list(range(starts)), 0
    costs = [np.inf] * starts
    while moving and rounds < most_rounds:
        rounds += 1
        still = []
        totals = _totals(vectors, [centres[s] for s in moving])
        for s, (n, cost, sums) in zip(moving, totals):
            costs[s] = cost.sum()
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[s])
            moved = np.sqrt(((new - centres[s]) ** 2).sum(1)).max()
            centres[s] = new
            if moved > TOLERANCE:
                still.append(s)
        moving = still
    costs = [float(cost.sum()) for _, cost, _ in _totals(vectors, centres)]
    best = int(np.argmin(costs))
    return Fit(centres[best], costs[best], costs, rounds)
