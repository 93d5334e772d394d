"""Logistic regression on sparse rows, with a penalty on given differences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rows:
    """Sparse rows: entry ``i`` adds ``values[i]`` in column ``columns[i]`` of row ``rows[i]``."""

    count: int
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.columns], self.count)

    def back(self, errors: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, self.values * errors[self.rows], width)


def fit(
    rows: Rows, labels: np.ndarray, changes: Rows, width: int, ridge: float = 2e-4,
    steady: float = 1.0, steps: int = 400,
) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent.

    The loss is the mean log loss, ``ridge`` times the squared weights and
    ``steady`` times the mean squared score change over the rows of ``changes``.
    """
    weights, intercept = np.zeros(width), 0.0
    if not rows.count:
        return weights, intercept
    n, m = rows.count, max(1, changes.count)
    square = np.bincount(rows.rows, rows.values**2, n).max(initial=0) + 1
    shift = np.bincount(changes.rows, changes.values**2, m).max(initial=0)
    rate = 1 / (square / 4 + 2 * ridge + 2 * steady * shift)
    ahead, ahead_0, speed = weights, intercept, 1.0
    for _ in range(steps):
        score = rows.times(ahead) + ahead_0
        error = 1 / (1 + np.exp(-score)) - labels
        slope = rows.back(error / n, width) + 2 * ridge * ahead
        if changes.count:
            slope += 2 * steady / m * changes.back(changes.times(ahead), width)
        new, new_0 = ahead - rate * slope, ahead_0 - rate * float(error.mean())
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        pull = (speed - 1) / faster
        ahead, ahead_0 = new + pull * (new - weights), new_0 + pull * (new_0 - intercept)
        weights, intercept, speed = new, new_0, faster
    return weights, intercept
