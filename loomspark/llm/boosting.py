"""Gradient-boosted trees for a logistic loss, on small tables of numeric features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited regression trees fitted to the gradients of the logistic loss, on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, leaf: float = 5.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.leaf = rounds, depth, rate, bins, leaf
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, cut, value; heap order
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            grad, hess = y - p, p * (1 - p)
            n = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(n, -1), np.zeros(n), np.zeros(n)
            node = np.zeros(len(y), dtype=np.int64)
            for k in range(n):
                rows = np.flatnonzero(node == k)
                if not len(rows):
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                value[k] = self.rate * g / (h + 1.0)
                if k >= n // 2:
                    continue
                best = (1e-6, -1, 0)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, grad[rows], len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[rows], len(cuts[f]) + 1))[:-1]
                    ok = (hl > self.leaf / 10) & (h - hl > self.leaf / 10)
                    gain = np.where(ok, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), -1)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], f, at)
                if best[1] >= 0:
                    feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
                    right = x[rows, best[1]] > cut[k]
                    node[rows] = np.where(right, 2 * k + 2, 2 * k + 1)
            z += value[node]
            self.trees.append((feature, cut, value))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            z += value[node]
        return z


class Calibration:
    """Platt scaling: a logistic of the trees' logits, fitted on held-out examples."""

    def __init__(self) -> None:
        self.a, self.b = 1.0, 0.0

    def fit(self, z: np.ndarray, y: np.ndarray) -> Calibration:
        x = np.stack([z, np.ones_like(z)], axis=1)
        beta = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * (beta - [1.0, 0.0]))
        self.a, self.b = map(float, beta)
        return self

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))
