"""A6, W5 at scale: exact quantiles by sketch and selection, without ordering the values.

A mergeable sketch of bounded size (KLL) brackets each wanted position. The next
scan counts the rows below, at and between the brackets' ends, and takes the
values strictly between them, of which there are few: their counts decide. A
value that many rows share becomes an end of its bracket and is only counted.
While too many rows are left between the ends, another scan narrows the
brackets by sketches of those rows; each one leaves about a thousandth.
Nothing is sorted or shuffled by value but what lies between.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.operators.cells import _cuts_below

#: Size of a sketch. Its rank error is about 0.0013 of the rows; three times that is allowed for.
SKETCH, ERROR = 4000, 0.004
#: Rows between all ends, about, from which on their values are fetched.
FETCHED = 100_000


def _cell(value: str, ends: Sequence[float]) -> Column:
    """Place of a value among the ends: even between two of them, odd at one.

    NULL is at -1, and NaN after all others, as at an end of its own.
    """
    code = F.lit(0)
    if ends:
        at = F.col(value).isin(list(ends)).cast("int")
        code = _cuts_below(ends, value) * 2 + at
    nan = F.when(F.isnan(value), 2 * len(ends) + 1)
    return F.when(F.col(value).isNull(), -1).otherwise(F.coalesce(nan, code))


class _Column:
    """The search in one column. Positions are ranks from 0 among all values that are not NULL."""

    def __init__(self, probabilities: Sequence[float]):
        self.probabilities, self.ends, self.rows = probabilities, [], None
        self.found: dict[int, float] = {}
        self.open: dict[int, set[int]] = {}  # cells that hold positions not found so far

    def _wanted(self) -> set[int]:
        exact = [p * (self.rows - 1) for p in self.probabilities]
        return {int(p) for p in exact} | {min(int(p) + 1, self.rows - 1) for p in exact}

    def place(self, counts: Mapping[int, int]) -> None:
        """Tell which cell holds each position, from the rows of each cell."""
        if self.rows is None:
            self.rows = sum(n for c, n in counts.items() if c >= 0)
        cells = sorted(c for c in counts if c >= 0)
        upto = list(accumulate(counts[c] for c in cells))
        self.open, self.before = {}, {c: u - counts[c] for c, u in zip(cells, upto)}
        for w in self._wanted() - set(self.found) if self.rows else ():
            cell = next(c for c, u in zip(cells, upto) if w < u)
            if cell % 2:
                self.found[w] = [*self.ends, math.nan][cell // 2]
            else:
                self.open.setdefault(cell, set()).add(w)

    def take(self, values: Mapping[int, list[tuple[float, int]]]) -> None:
        """Find positions in the cells whose values are all there."""
        for cell, wanted in self.open.items():
            if cell not in values:
                continue
            ordered = sorted(values[cell])
            upto = list(accumulate(n for _, n in ordered))
            for w in wanted:
                local = w - self.before[cell]
                self.found[w] = next(v for (v, _), u in zip(ordered, upto) if local < u)

    def result(self) -> list[float | None]:
        if not self.rows:
            return [None] * len(self.probabilities)
        out = []
        for p in self.probabilities:
            exact = p * (self.rows - 1)
            low, high = self.found[int(exact)], self.found[min(int(exact) + 1, self.rows - 1)]
            out.append(low if low == high or exact == int(exact) else low + (high - low) * (exact - int(exact)))
        return out


def _narrow(df: DataFrame, name: str, column: _Column) -> tuple[float, set[int]]:
    """Place brackets around the open positions: rows within them, about, and their cells."""
    cells = df.groupBy(_cell(name, column.ends).alias("cell")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(name, F.lit(SKETCH)).alias("sketch"))
    counted = {r["cell"]: (r["n"], r["sketch"]) for r in cells.collect()}
    column.place({c: n for c, (n, _) in counted.items()})
    sides, expected = {}, 0.0  # low and high rank of each position within its cell
    for cell, wanted in column.open.items():
        n = counted[cell][0]
        for w in wanted:
            at = (w - column.before[cell]) / n
            sides[cell, w] = max(0.0, at - ERROR), min(1.0, at + ERROR)
        expected += min(1.0, 2 * ERROR * len(wanted)) * n
    if not sides:
        return 0.0, set()
    ranks = sorted({r for pair in sides.values() for r in pair})
    sketches = df.sparkSession.createDataFrame(
        [(c, bytearray(counted[c][1])) for c in column.open], "cell int, sketch binary")
    asked = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ranks)))
    answers = {r["cell"]: dict(zip(ranks, r["ends"])) for r in
               sketches.select("cell", asked.alias("ends")).collect()}
    found = [tuple(answers[cell][r] for r in pair) for (cell, _), pair in sides.items()]
    column.ends = sorted({*column.ends, *(end for pair in found for end in pair)})
    place = {end: i for i, end in enumerate(column.ends)}
    return expected, {2 * i for low, high in found
                      for i in range(place[low] + 1, place[high] + 1)}


def _fetch(df: DataFrame, name: str, column: _Column, brackets: set[int]) -> None:
    """Count all cells, with the values of those that lie within brackets."""
    cell = _cell(name, column.ends)
    value = F.when(cell.isin([*sorted(brackets), -2]), F.col(name))  # -2 is no cell
    counts = df.groupBy(cell.alias("cell"), value.alias("value")).agg(F.count("*").alias("n"))
    sums: dict[int, int] = {}
    values: dict[int, list[tuple[float, int]]] = {}
    for r in counts.collect():
        sums[r["cell"]] = sums.get(r["cell"], 0) + r["n"]
        if r["cell"] in brackets:
            values.setdefault(r["cell"], []).append((r["value"], r["n"]))
    column.place(sums)
    column.take(values)


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], fetched: int = FETCHED,
) -> dict[str, list[float | None]]:
    """For each column its exact quantiles, with linear interpolation between neighbours.

    As ``prefix.quantiles``, value for value: NULLs do not count, NaN is the
    largest value, a column without values gives None. Two scans per column are
    enough up to ``fetched`` over twice the error rows (12 million for one
    position); every further scan does for hundreds of times as many.
    """
    out = {}
    for name, probabilities in wanted.items():
        values = df.select(F.col(name).cast("double").alias("value"))
        column = _Column(probabilities)
        while column.rows is None or (column.rows and column._wanted() - set(column.found)):
            between, brackets = _narrow(values, "value", column)
            if column.open and between <= fetched:
                _fetch(values, "value", column, brackets)
        out[name] = column.result()
    return out
