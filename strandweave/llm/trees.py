"""Boosted regression trees for binary labels, in numpy, over quantile-binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Arrays by node; ``feature`` is -1 at a leaf. A row goes left where its value is <= ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            go_left = x[rows, np.maximum(f, 0)] <= self.cut[at]
            at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)

    def paths(self) -> list[tuple[tuple[int, str, float], ...]]:
        """The conjunction of conditions that leads to each node but the root."""
        out, todo = [], [(0, ())]
        while todo:
            node, conditions = todo.pop()
            if conditions:
                out.append(conditions)
            if self.feature[node] >= 0:
                f, c = int(self.feature[node]), float(self.cut[node])
                todo.append((int(self.left[node]), (*conditions, (f, "<=", c))))
                todo.append((int(self.right[node]), (*conditions, (f, ">", c))))
        return out


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * tree.predict(x)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _grow(binned, cuts, grad, hess, depth, min_rows, ridge) -> Tree:
    feature, cut, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        g, h = grad[rows].sum(), hess[rows].sum()
        for column, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, -g / (h + ridge))):
            column.append(v)
        if level == depth or len(rows) < 2 * min_rows:
            return me
        best = (1e-6, -1, -1)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            b, size = binned[rows, f], len(edges) + 1
            gs = np.bincount(b, grad[rows], size).cumsum()[:-1]
            hs = np.bincount(b, hess[rows], size).cumsum()[:-1]
            ns = np.bincount(b, minlength=size).cumsum()[:-1]
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(ns < min_rows) | (len(rows) - ns < min_rows)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] >= 0:
            _, f, k = best
            low = binned[rows, f] <= k
            feature[me], cut[me] = f, cuts[f][k]
            left[me] = node(rows[low], level + 1)
            right[me] = node(rows[~low], level + 1)
        return me

    node(np.arange(len(binned)), 0)
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, min_rows: int = 10, ridge: float = 1.0) -> Boosted:
    """Fit trees to the logistic loss. With one class only, a constant model results."""
    p = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    model = Boosted(float(np.log(p / (1 - p))), rate, [])
    if len(y) < 2 * min_rows or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        q = sigmoid(margin)
        tree = _grow(binned, cuts, q - y, np.maximum(q * (1 - q), 1e-6), depth, min_rows, ridge)
        model.trees.append(tree)
        margin += rate * tree.predict(x)
    return model
