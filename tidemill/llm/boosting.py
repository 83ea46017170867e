"""Gradient-boosted trees for small tables of features, in numpy: trained on the driver, applied in tasks."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Complete trees of one depth on binned features, logistic loss with Newton steps."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.features = self.cuts = self.leaves = None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, n_bins = self._binned(x), self.bins + 1
        n, m = b.shape
        inner = 2**self.depth - 1
        mean = np.clip((y * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        features, cuts, leaves = [], [], []
        flat = b.astype(np.int64) + np.arange(m) * n_bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            node = np.zeros(n, np.int64)
            f, c = np.zeros(inner, np.int64), np.full(inner, n_bins, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                size = width * m * n_bins
                at = ((node - first) * (m * n_bins))[:, None] + flat
                gs = np.bincount(at.ravel(), np.repeat(g, m), size).reshape(width, m, n_bins).cumsum(2)
                hs = np.bincount(at.ravel(), np.repeat(h, m), size).reshape(width, m, n_bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < 1.0) | (ht - hs < 1.0)] = 0
                best = gain.reshape(width, -1).argmax(1)
                split = gain.reshape(width, -1)[np.arange(width), best] > 1e-3
                f[first : first + width] = np.where(split, best // n_bins, 0)
                c[first : first + width] = np.where(split, best % n_bins, n_bins)
                node = 2 * node + 1 + (b[np.arange(n), f[node]] > c[node])
            leaf = node - inner
            value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge) * self.rate
            score += value[leaf]
            features.append(f)
            cuts.append(c)
            leaves.append(value)
        self.features, self.cuts, self.leaves = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of each row."""
        if not len(x):
            return np.empty(0)
        b = self._binned(x)
        rows, score = np.arange(len(b)), np.full(len(b), self.base)
        for f, c, v in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            score += v[node - len(f)]
        return 1 / (1 + np.exp(-score))
