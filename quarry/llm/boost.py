"""Gradient-boosted trees for a yes-or-no label, in numpy: small enough to train on the driver and send out."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, LAMBDA, BINS = 40, 3, 0.2, 1.0, 32


class Boosted:
    """Trees of logistic loss on binned features. fit and predict take float matrices, a row for each case.

    Bins are of the rows as given, so a row of great weight doesn't hide the differences among others.
    """

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        p = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        self.trees: list[list[tuple[int, int, float]]] = []
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, weight * (q - y), weight * np.maximum(q * (1 - q), 1e-6), weight)
            self.trees.append(tree)
            score += self._walk(tree, binned)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return 1 / (1 + np.exp(-(self.start + sum(self._walk(t, binned) for t in self.trees))))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float]]:
        """Nodes of a full binary tree in level order: (feature or -1, last bin that goes left, value)."""
        nodes: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (DEPTH + 1) - 1)
        at = {0: np.arange(len(grad))}
        for node in range(len(nodes)):
            if (rows := at.pop(node, None)) is None:
                continue
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes[node] = (-1, 0, float(-RATE * g / (h + LAMBDA)))
            if node >= 2**DEPTH - 1 or weight[rows].sum() < 8:
                continue
            best, pick = 1e-6, None
            for j, e in enumerate(self.edges):
                gs = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(e) + 1))[:-1]
                gain = gs**2 / (hs + LAMBDA) + (g - gs) ** 2 / (h - hs + LAMBDA) - g**2 / (h + LAMBDA)
                if len(gain) and gain.max() > best:
                    best, pick = gain.max(), (j, int(gain.argmax()))
            if pick:
                left = binned[rows, pick[0]] <= pick[1]
                nodes[node] = (*pick, 0.0)
                at[2 * node + 1], at[2 * node + 2] = rows[left], rows[~left]
        return nodes

    @staticmethod
    def _walk(nodes: list[tuple[int, int, float]], binned: np.ndarray) -> np.ndarray:
        feature, split, value = (np.array(c) for c in zip(*nodes, strict=True))
        at = np.zeros(len(binned), dtype=int)
        for _ in range(DEPTH):
            f = feature[at]
            inner = f >= 0
            goes = 2 * at + 1 + (binned[np.arange(len(at)), np.maximum(f, 0)] > split[at])
            at = np.where(inner, goes, at)
        return value[at]
