"""Gradient-boosted trees for small feature tables: logistic loss, trees of
fixed depth on binned features, fitted in numpy on the driver from a bounded
sample and small enough to send to every task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Tree:
    feature: np.ndarray  # per inner node in level order; -1: no split
    cut: np.ndarray  # values up to the cut go left
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(int(np.log2(len(self.leaf)))):
            f = self.feature[node]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[node])
            node = 2 * node + 1 + right
        return self.leaf[node - len(self.feature)]


@dataclass
class Model:
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.score(x)
        return out


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, rate: float,
          smooth: float, least: float) -> Tree:
    inner = (1 << depth) - 1
    tree = Tree(np.full(inner, -1), np.zeros(inner), np.zeros(1 << depth))
    node = np.zeros(len(x), dtype=np.int64)
    for n in range(inner):
        rows = np.flatnonzero(node == n)
        best = (1e-9, -1, 0.0)
        if len(rows):
            g, h = grad[rows], hess[rows]
            whole = g.sum() ** 2 / (h.sum() + smooth)
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                bins = np.searchsorted(edges, x[rows, f], side="left")
                gl = np.cumsum(np.bincount(bins, g, len(edges) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins, h, len(edges) + 1))[:-1]
                gain = gl ** 2 / (hl + smooth) + (g.sum() - gl) ** 2 / (h.sum() - hl + smooth) - whole
                gain[(hl < least) | (h.sum() - hl < least)] = 0
                top = int(np.argmax(gain))
                if gain[top] > best[0]:
                    best = (float(gain[top]), f, float(edges[top]))
        tree.feature[n], tree.cut[n] = best[1], best[2]
        right = (x[rows, best[1]] > best[2]) if best[1] >= 0 else np.zeros(len(rows), dtype=bool)
        node[rows] = 2 * n + 1 + right
    for leaf in range(1 << depth):
        rows = node == inner + leaf
        tree.leaf[leaf] = -rate * grad[rows].sum() / (hess[rows].sum() + smooth)
    return tree


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, smooth: float = 1.0,
        least: float = 0.5) -> Model:
    """Boosted trees for P(y = 1)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Model(float(np.log(share / (1 - share))), [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    margin = np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, cuts, p - y, p * (1 - p), depth, rate, smooth, least)
        model.trees.append(tree)
        margin += tree.score(x)
    return model


def calibrate(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest margin from which held-out precision is at least
    ``precision`` all the way up, half-way to the next margin below; infinity if
    there is none."""
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(y[order])
    good = hits >= precision * np.arange(1, len(y) + 1)
    last_of_tie = np.append(margin[order][1:] != margin[order][:-1], True) if len(y) else good
    fine = np.flatnonzero(good & last_of_tie)
    if not len(fine):
        return float("inf")
    stop = np.flatnonzero(~good & last_of_tie)
    limit = stop[0] if len(stop) else len(y)
    fine = fine[fine < limit]
    if not len(fine):
        return float("inf")
    ranked, last = margin[order], fine[-1]
    return float((ranked[last] + ranked[last + 1]) / 2 if last + 1 < len(ranked) else ranked[last])
