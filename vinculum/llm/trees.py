"""Gradient-boosted trees for binary labels on small tables, in numpy; trained on bounded samples, applied to any number of rows."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with trees of fixed depth; thresholds are taken from at most ``bins`` quantiles of each feature."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x = np.asarray(x, dtype=np.float32)
        p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]  # a constant feature has none
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        width = max(map(len, cuts), default=0) + 1
        open_ = np.array([[k < len(c) for k in range(width)] for c in cuts])
        flat = codes + np.arange(len(cuts)) * width
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            tree = self._grow(codes, flat, open_, cuts, g, h)
            self.trees.append(tree)
            f += self._value(tree, x)
        return self

    def _grow(self, codes, flat, open_, cuts, g, h):
        """One tree, level by level; the sums of all features and nodes of a level are counted at once."""
        size = 2**self.depth - 1
        feature, cut = np.zeros(size, dtype=np.int32), np.full(size, np.inf, dtype=np.float32)
        node = np.zeros(len(g), dtype=np.int64)
        columns, width = open_.shape
        many_g, many_h = np.repeat(g, columns), np.repeat(h, columns)
        for d in range(self.depth):
            first, nodes = 2**d - 1, 2**d
            at = (flat + (node - first)[:, None] * (columns * width)).ravel()
            shape = nodes, columns, width
            gs = np.cumsum(np.bincount(at, many_g, nodes * columns * width).reshape(shape), axis=2)
            hs = np.cumsum(np.bincount(at, many_h, nodes * columns * width).reshape(shape), axis=2)
            total_g, total_h = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + self.least) + (total_g - gs) ** 2 / (total_h - hs + self.least) - total_g**2 / (total_h + self.least)
            gain = np.where(open_, gain, -1.0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            column, place = best // width, best % width
            for k in np.flatnonzero(gain[np.arange(nodes), best] > 1e-9):
                feature[first + k], cut[first + k] = column[k], cuts[column[k]][place[k]]
            chosen = node - first
            right = (codes[np.arange(len(g)), column[chosen]] > place[chosen]) & (gain[chosen, best[chosen]] > 1e-9)
            node = 2 * node + 1 + right
        leaf = node - size
        value = np.bincount(leaf, g, size + 1) / (np.bincount(leaf, h, size + 1) + self.least) * self.rate
        return feature, cut, value

    def _value(self, tree, x):
        feature, cut, value = tree
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return value[node - (2**self.depth - 1)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float32)
        f = np.full(len(x), self.start)
        for tree in self.trees:
            f += self._value(tree, x)
        return 1 / (1 + np.exp(-f))
