"""Gradient-boosted trees for two classes, with monotonic constraints, flattened into arrays of nodes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees: node k has the children 2k+1 and 2k+2; a row goes right where its feature exceeds the threshold."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2^depth)
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, ridge: float = 1.0, bins: int = 64, least: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss over binned features. monotone: +1, -1 or 0 for each feature.

    Where a feature is constrained, a split must order its children's values, and each child is held on its side of their mean,
    so no deeper split can undo the order. Rows of one class, or none, give a constant.
    """
    inner, leaves = 2**depth - 1, 2**depth
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    shape = (trees if len(np.unique(y)) == 2 else 0, inner)
    forest = Forest(np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros((shape[0], leaves)), base)
    if not shape[0]:
        return forest
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin > b means x > edges[b]
    score = np.full(len(y), base)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        value = np.zeros(inner + leaves)
        value[0] = np.clip(-gradient.sum() / (weight.sum() + ridge), low[0], high[0])
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            value[2 * k + 1 : 2 * k + 3], low[2 * k + 1 : 2 * k + 3], high[2 * k + 1 : 2 * k + 3] = value[k], low[k], high[k]
            best = (1e-6, 0, 0, 0.0, 0.0)
            g_all, h_all = gradient[rows].sum(), weight[rows].sum()
            worth = lambda g, h, v: -(g * v + 0.5 * (h + ridge) * v * v)
            for f, e in enumerate(edges if len(rows) else []):
                g = np.cumsum(np.bincount(binned[rows, f], gradient[rows], len(e) + 1))[:-1]
                h = np.cumsum(np.bincount(binned[rows, f], weight[rows], len(e) + 1))[:-1]
                left, right = np.clip(-g / (h + ridge), low[k], high[k]), np.clip(-(g_all - g) / (h_all - h + ridge), low[k], high[k])
                gain = worth(g, h, left) + worth(g_all - g, h_all - h, right) - worth(g_all, h_all, value[k])
                gain[(h < least) | (h_all - h < least) | (monotone[f] * (right - left) < 0)] = -np.inf
                if len(gain) and gain.max() > best[0]:
                    b = int(gain.argmax())
                    best = (float(gain[b]), f, b, float(left[b]), float(right[b]))
            if best[0] > 1e-6:
                _, f, b, left, right = best
                forest.feature[tree, k], forest.threshold[tree, k] = f, edges[f][b]
                value[2 * k + 1], value[2 * k + 2] = left, right
                if monotone[f]:
                    middle = (left + right) / 2
                    (high if monotone[f] > 0 else low)[2 * k + 1] = middle
                    (low if monotone[f] > 0 else high)[2 * k + 2] = middle
            node[rows] = 2 * k + 1 + (x[rows, forest.feature[tree, k]] > forest.threshold[tree, k])
        forest.leaf[tree] = rate * value[inner:]
        score += forest.leaf[tree][node - inner]
    return forest
