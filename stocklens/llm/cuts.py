"""Cuts of a whole-number column into ranges of equal numbers of rows, and names that are free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_points(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` different values, ascending; none for an empty column.

    Tasks send summaries of bounded size, and the cuts are that many numbers.
    """
    if parts <= 1:
        return []
    steps = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, steps, max(1000, 5 * parts))).first()[0]
    return sorted(set(found or []))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until the frame has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out
