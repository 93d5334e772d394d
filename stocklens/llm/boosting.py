"""Histogram gradient-boosted trees for two classes, as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth; node ``i`` has children ``2i+1`` and ``2i+2``."""

    start: float
    features: np.ndarray  # trees x inner nodes
    limits: np.ndarray  # trees x inner nodes; larger values go right
    leaves: np.ndarray  # trees x leaves

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row; all rows walk a tree together."""
        rows, inner = np.arange(len(values)), self.features.shape[1]
        total = np.full(len(values), self.start)
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(values), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (values[rows, feature[node]] > limit[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def _binned(values: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    edges, codes = [], np.zeros(values.shape, np.int64)
    for j in range(values.shape[1]):
        cuts = np.unique(np.quantile(values[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        edges.append(cuts)
        codes[:, j] = np.searchsorted(cuts, values[:, j], "left")
    return codes, edges


def fit(
    values: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 48,
    rate: float = 0.15, ridge: float = 2.0, least: float = 1.0,
) -> Forest:
    """Boost trees on the logistic loss.

    ``least`` is the smallest sum of second derivatives in a child. Without rows
    the forest says 0.5, with one class only about that class.
    """
    n, width = values.shape
    inner = (1 << depth) - 1
    if n == 0:
        flat = np.zeros((0, inner))
        return Forest(0.0, flat.astype(np.int64), flat, np.zeros((0, inner + 1)))
    share = np.clip(labels.mean(), 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    start = float(np.log(share / (1 - share)))
    codes, edges = _binned(values, bins)
    cell = codes + np.arange(width) * bins
    total = np.full(n, start)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = labels - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        cut = np.full(inner, bins)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * bins) + cell).ravel()
            size = count * width * bins
            g = np.bincount(at, np.repeat(grad, width), size).reshape(count, width, bins)
            h = np.bincount(at, np.repeat(hess, width), size).reshape(count, width, bins)
            gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            gt, ht = g.sum(2)[:, :, None], h.sum(2)[:, :, None]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for i, k in enumerate(best):
                j, b = divmod(int(k), bins - 1)
                if gain[i, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + i], cut[first + i], limit[first + i] = j, b, edges[j][b]
            node = 2 * node + 1 + (codes[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = rate * g / (h + ridge)
        total += value[leaf]
        grown.append((feature, limit, value))
    return Forest(start, *(np.array(x) for x in zip(*grown)))
