"""Small gradient-boosted trees for binary labels, fitted on the driver on a bounded training set."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Logistic loss, second-order gains, complete trees of a fixed depth over at most 32 cuts a feature."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.ridge = trees, depth, rate, ridge
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0

    def _grow(self, x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << self.depth) - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            if len(rows) >= 4:
                gk, hk, best = g[rows], h[rows], 1e-9
                whole = gk.sum() ** 2 / (hk.sum() + self.ridge)
                for f, own in enumerate(cuts):
                    if not len(own):
                        continue
                    place = np.searchsorted(own, x[rows, f], side="left")
                    gl, hl = np.cumsum(np.bincount(place, gk, len(own) + 1))[:-1], np.cumsum(np.bincount(place, hk, len(own) + 1))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (gk.sum() - gl) ** 2 / (hk.sum() - hl + self.ridge) - whole
                    if gain.max() > best:
                        best, feature[k], cut[k] = gain.max(), f, own[gain.argmax()]
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
        leaf = node - inner
        value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge) * self.rate
        return feature, cut, value

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = []
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            mid = (v[1:] + v[:-1]) / 2
            cuts.append(mid if len(mid) <= 32 else np.unique(np.quantile(mid, np.linspace(0, 1, 32))))
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        score = np.full(len(x), self.bias)
        for _ in range(self.trees):
            p = _sigmoid(score)
            self.splits.append(self._grow(x, cuts, p - y, p * (1 - p)))
            score += self._one(x, self.splits[-1])
        return self

    def _one(self, x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((self._one(x, t) for t in self.splits), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on rows that the trees haven't seen, by Newton steps; the counts are smoothed."""
        s = self.raw(x)
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = _sigmoid(a * s + b)
            w = p * (1 - p) + 1e-9
            hess = np.array([[(w * s * s).sum() + 1e-6, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            da, db = np.linalg.solve(hess, [((p - t) * s).sum(), (p - t).sum()])
            a, b = a - da, b - db
        self.slope, self.offset = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.offset)


def threshold(p: np.ndarray, y: np.ndarray, precision: float = 0.98) -> float:
    """The lowest calibrated probability, of a half or more, from which on at least this share of held-out rows is positive."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.flatnonzero((share >= precision) & np.append(p[order][1:] < p[order][:-1], True))
    return max(0.5, float(p[order][last[-1]])) if len(last) else 0.5
