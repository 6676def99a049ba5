"""Gradient-boosted trees on a bounded sample of labelled rows: a few kilobytes that travel to the tasks."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Binary classifier: logistic loss, depth-wise trees on quantile bins, calibrated on held-out rows."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    start: float = 0.0
    threshold: float = 0.5
    model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not len(x):
            self.model = []
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.model = float(np.log(p / (1 - p))), []
        f, nodes = np.full(len(y), self.start), 2**self.depth - 1
        for _ in range(self.trees if 0 < y.sum() < len(y) else 0):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob)
            feature, cut, at = np.zeros(nodes, int), np.full(nodes, np.inf), np.zeros(len(y), int)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                best, where = 1e-6, None
                for j, e in enumerate(edges):
                    if len(e) and len(rows):
                        sg = np.bincount(binned[rows, j], g[rows], len(e) + 1).cumsum()
                        sh = np.bincount(binned[rows, j], h[rows], len(e) + 1).cumsum()
                        gain = sg[:-1] ** 2 / (sh[:-1] + self.ridge) + (sg[-1] - sg[:-1]) ** 2 / (sh[-1] - sh[:-1] + self.ridge) - sg[-1] ** 2 / (sh[-1] + self.ridge)
                        if gain.max() > best:
                            best, where = gain.max(), (j, int(gain.argmax()))
                if where:
                    feature[node], cut[node] = where[0], edges[where[0]][where[1]]
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            leaf = at - nodes
            value = self.rate * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + self.ridge)
            self.model.append((feature, cut, value))
            f += value[leaf]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.model:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            f += value[at - len(cut)]
        return 1 / (1 + np.exp(-f))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> BoostedTrees:
        """The lowest threshold at which held-out rows above it are right with the given precision; else above 1."""
        self.threshold = threshold_at(self.probability(x), y, precision)
        return self


def threshold_at(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability at which rows above it are right with the given precision; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(np.asarray(y)[order]) / np.arange(1, len(order) + 1)
    last = np.ones(len(order), bool)
    last[:-1] = p[order][:-1] > p[order][1:]
    good = np.flatnonzero((hits >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 1.1


def fitted(x: np.ndarray, y: np.ndarray, precision: float, **options) -> BoostedTrees:
    """Trees fitted on four fifths of the rows, the threshold calibrated on the others."""
    held = np.arange(len(y)) % 5 == 4
    return BoostedTrees(**options).fit(x[~held], y[~held]).calibrate(x[held], y[held], precision)


def entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.array(list(Counter(text).values()), float) / len(text)
    return float(-(counts * np.log2(counts)).sum())
