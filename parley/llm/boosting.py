"""Gradient-boosted trees of the logistic loss over binned features, in a few array operations."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Boosted(NamedTuple):
    """Complete trees of one depth: by tree and inner node a feature and a threshold, by leaf a value."""

    feature: np.ndarray  # [tree, 2 ** depth - 1]
    threshold: np.ndarray
    value: np.ndarray  # [tree, 2 ** depth]
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 5.0) -> Boosted:
    """Newton steps: each level takes the best split of every node from histograms of gradients."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    n, d = x.shape
    inner = 2 ** depth - 1
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    z = np.full(n, base)
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, 2 ** depth))
    cells = binned + np.arange(d) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            flat = ((node - first)[:, None] * (d * bins) + cells).ravel()
            sums = [np.bincount(flat, np.repeat(w, d), width * d * bins).reshape(width, d, bins).cumsum(2) for w in (g, h)]
            left_g, left_h = sums
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g ** 2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g ** 2 / (all_h + ridge)
            best = gain.reshape(width, -1).argmax(1)
            for k, b in enumerate(best):
                f, c = divmod(int(b), bins)
                if c < len(cuts[f]) and gain[k, f, c] > 1e-6:
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, 2 ** depth) / (np.bincount(leaf, h, 2 ** depth) + ridge)
        z += value[t][leaf]
    return Boosted(feature, threshold, value, base)
