"""Small models: logistic regression, fitted on the driver over documented, bounded samples, and boosted trees (``boosting`` fits them on tables of any size)."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Logistic:
    """L2 logistic regression by Newton steps on standardised columns."""

    def __init__(self, l2: float = 1.0, steps: int = 30) -> None:
        self.l2, self.steps = l2, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        x = np.asarray(x, float)
        self.mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.scale = np.where(scale > 1e-9, scale, np.inf)  # a constant column says nothing
        w = np.ones(len(x)) if weight is None else weight
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        self.beta = np.zeros(z.shape[1])
        share = np.clip((w @ y + 0.5) / (w.sum() + 1.0), 1e-6, 1 - 1e-6)
        self.beta[-1] = np.log(share / (1 - share))
        penalty = np.full(len(self.beta), self.l2)
        penalty[-1] = 1e-9
        if not len(x) or not 0 < y.sum() < len(y):
            return self
        for _ in range(self.steps):
            p = sigmoid(z @ self.beta)
            slope = z.T @ (w * (y - p)) - penalty * self.beta
            curve = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            self.beta += step
            if np.abs(step).max() < 1e-8:
                break
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((np.asarray(x, float) - self.mean) / self.scale) @ self.beta[:-1] + self.beta[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


class Boosted:
    """Gradient boosting for a yes/no label: trees of fixed depth on columns binned at quantiles."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.asarray(x, float)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base, self.forest = float(np.log(share / (1 - share))), []
        b, f = self._bin(x), np.full(len(x), self.base)
        for _ in range(self.trees):
            p = sigmoid(f)
            grad, hess, node, tree = y - p, np.maximum(p * (1 - p), 1e-6), np.zeros(len(x), np.int64), []
            for level in range(self.depth):
                n, k = 2**level, self.bins + 1
                best = np.zeros(n)
                feature, cut = np.zeros(n, np.int64), np.full(n, k)  # a cut beyond all bins: nothing goes right
                for j in range(b.shape[1]):
                    at = node * k + b[:, j]
                    g = np.cumsum(np.bincount(at, grad, n * k).reshape(n, k), 1)
                    h = np.cumsum(np.bincount(at, hess, n * k).reshape(n, k), 1)
                    rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                    gain = g**2 / (h + self.l2) + rest_g**2 / (rest_h + self.l2) - g[:, -1:] ** 2 / (h[:, -1:] + self.l2)
                    c = gain.argmax(1)
                    more = gain[np.arange(n), c] > best + 1e-9
                    best, feature, cut = np.where(more, gain[np.arange(n), c], best), np.where(more, j, feature), np.where(more, c, cut)
                tree.append((feature, cut))
                node = node * 2 + (b[np.arange(len(x)), feature[node]] > cut[node])
            n = 2**self.depth
            leaf = self.rate * np.bincount(node, grad, n) / (np.bincount(node, hess, n) + self.l2)
            self.forest.append((tree, leaf))
            f += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._bin(np.asarray(x, float)), np.arange(len(x))
        f = np.full(len(x), self.base)
        for tree, leaf in self.forest:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            f += leaf[node]
        return f
