"""Gradient-boosted trees for two classes, small enough to send to every task."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth over quantile bins, fitted to the logistic loss with Newton steps."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 8.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.feature = self.border = self.value = None

    def _binned(self, X: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, X[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int32)

    def fit(self, X: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        n, d = X.shape
        w = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        B = self._binned(X)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.border = np.full((self.trees, inner), self.bins + 1, np.int32)
        self.value = np.zeros((self.trees, leaves))
        mean = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        width = self.bins + 1
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (p - y), w * p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                start, count = 2**level - 1, 2**level
                at = node - start
                G = np.empty((d, count, width))
                H = np.empty((d, count, width))
                for j in range(d):
                    slot = at * width + B[:, j]
                    G[j] = np.bincount(slot, g, count * width).reshape(count, width)
                    H[j] = np.bincount(slot, h, count * width).reshape(count, width)
                GL, HL = G.cumsum(2), H.cumsum(2)
                GT, HT = GL[:, :, -1:], HL[:, :, -1:]
                gain = GL**2 / (HL + self.ridge) + (GT - GL) ** 2 / (HT - HL + self.ridge) - GT**2 / (HT + self.ridge)
                gain[(HL < self.least / 4) | (HT - HL < self.least / 4)] = 0
                flat = gain.transpose(1, 0, 2).reshape(count, -1)
                best = flat.argmax(1)
                good = flat[np.arange(count), best] > 1e-6
                self.feature[t, start : start + count] = np.where(good, best // width, 0)
                self.border[t, start : start + count] = np.where(good, best % width, width)
                f, b = self.feature[t, node], self.border[t, node]
                node = 2 * node + 1 + (B[np.arange(n), f] > b)
            leaf = node - inner
            sg, sh = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
            self.value[t] = -self.rate * sg / (sh + self.ridge)
            score += self.value[t][leaf]
        return self

    def score(self, X: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(X), self.base)
        if not len(X):
            return out
        B = self._binned(X)
        rows = np.arange(len(X))
        for t in range(self.trees):
            node = np.zeros(len(X), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (B[rows, self.feature[t, node]] > self.border[t, node])
            out += self.value[t][node - (2**self.depth - 1)]
        return out
