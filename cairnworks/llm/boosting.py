"""Gradient-boosted regression trees with logistic loss over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A complete binary tree of one depth: splits by level order, then leaf values."""

    features: np.ndarray
    bounds: np.ndarray
    leaves: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(len(self.leaves).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.features[at]] > self.bounds[at])
        return self.leaves[at - len(self.features)]


@dataclass
class Boosted:
    trees: list[Tree]
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.predict(x)
        return out


def train(x: np.ndarray, y: np.ndarray, weights: np.ndarray, rounds: int = 100, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Second-order boosting; splits are the best among up to ``bins`` quantiles of each feature."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], axis=1)
    p0 = float(np.clip(np.average(y, weights=weights), 1e-3, 1 - 1e-3))
    model = Boosted([], float(np.log(p0 / (1 - p0))))
    score = np.full(n, model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weights * (p - y), weights * p * (1 - p)
        features, bounds = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            gain_of, best = np.zeros(width), [(0, np.inf, -1)] * width
            g_all, h_all = np.bincount(node, g, width), np.bincount(node, h, width)
            before = g_all**2 / (h_all + ridge)
            for f in range(m):
                size = len(cuts[f]) + 1
                if size == 1:
                    continue
                cell = node * size + binned[:, f]
                gl = np.cumsum(np.bincount(cell, g, width * size).reshape(width, size), axis=1)[:, :-1]
                hl = np.cumsum(np.bincount(cell, h, width * size).reshape(width, size), axis=1)[:, :-1]
                gr, hr = g_all[:, None] - gl, h_all[:, None] - hl
                gain = np.where((hl > 0.5) & (hr > 0.5), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - before[:, None], 0)
                k = gain.argmax(axis=1)
                for j in np.flatnonzero(gain[np.arange(width), k] > gain_of + 1e-9):
                    gain_of[j], best[j] = gain[j, k[j]], (f, cuts[f][k[j]], k[j])
            right = np.zeros(n, np.int64)
            for j, (f, bound, k) in enumerate(best):
                features[first + j], bounds[first + j] = f, bound
                if k >= 0:
                    mine = node == j
                    right[mine] = binned[mine, f] > k
            node = 2 * node + right
        width = 2**depth
        leaves = -rate * np.bincount(node, g, width) / (np.bincount(node, h, width) + ridge)
        model.trees.append(Tree(features, bounds, leaves))
        score += leaves[node]
    return model
