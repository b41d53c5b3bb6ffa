"""Small gradient-boosted trees for bounded training sets, fitted with numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Binary classifier: logistic loss, complete trees of fixed depth, binned features.

    A tree is three arrays: the feature and the upper border of every inner node in
    heap order and the value of every leaf, so scoring is ``depth`` array steps.
    """

    def __init__(self, rounds: int = 60, depth: int = 4, step: float = 0.2, smoothing: float = 1.0):
        self.rounds, self.depth, self.step, self.smoothing = rounds, depth, step, smoothing
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(binned, cuts, y - p, p * (1 - p))
            raw += tree[2][leaf]
            self.trees.append(tree)
        return self

    def _grow(self, binned, cuts, gradient, curvature):
        inner = (1 << self.depth) - 1
        feature, border = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(gradient), dtype=np.int64)
        for level in range(self.depth):
            first, n = (1 << level) - 1, 1 << level
            place = (at - first) * BINS
            best = np.full(n, 1e-6)
            cut = np.full(n, BINS, dtype=np.int64)
            for f in range(binned.shape[1]):
                key = place + binned[:, f]
                g = np.bincount(key, gradient, n * BINS).reshape(n, BINS).cumsum(axis=1)
                h = np.bincount(key, curvature, n * BINS).reshape(n, BINS).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                lam = self.smoothing
                gain = g**2 / (h + lam) + (gt - g) ** 2 / (ht - h + lam) - gt**2 / (ht + lam)
                gain[:, len(cuts[f]) :] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(n), k] > best
                best[better] = gain[np.arange(n), k][better]
                feature[first : first + n][better] = f
                cut[better] = k[better]
            for node in range(n):
                if cut[node] < BINS:
                    border[first + node] = cuts[feature[first + node]][cut[node]]
            right = binned[np.arange(len(at)), feature[at]] > cut[at - first]
            at = 2 * at + 1 + right
        leaf = at - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, curvature, inner + 1)
        return (feature, border, self.step * g / (h + self.smoothing)), leaf

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, border, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > border[at])
            out += value[at - len(feature)]
        return out
