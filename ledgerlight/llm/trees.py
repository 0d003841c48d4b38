"""Gradient-boosted trees with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth; node i of a tree has the children 2i + 1 and 2i + 2.

    feature and threshold: trees x inner nodes; value: trees x leaves. A row goes
    right where its feature exceeds the threshold.
    """

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every, inner = np.arange(len(rows)), (1 << self.depth) - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += value[node - inner]
        return total

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(rows)))


def fit(
    rows: np.ndarray, labels: np.ndarray, monotone: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 64, smooth: float = 1.0, least: float = 1.0,
) -> Forest:
    """Logistic boosting on histograms.

    monotone has +1 (score never falls with the feature), -1 (never rises) or 0 per
    feature. A split that breaks it is not taken, and both children's values are
    kept on their side of the split's midpoint, down to the leaves. Without rows,
    or with one class only, the forest has no splits.
    """
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    if not len(rows) or labels.min() == labels.max():
        return Forest(base, depth, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
    codes = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score = np.full(len(rows), base)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(codes, cuts, labels - p, p * (1 - p), monotone, depth, bins, smooth, least)
        tree[2][:] *= rate
        made.append(tree)
        score += Forest(0.0, depth, *(a[None] for a in tree)).raw(rows)
    return Forest(base, depth, *(np.stack(x) for x in zip(*made)))


def _grow(codes, cuts, grad, hess, monotone, depth, bins, smooth, least):
    inner = (1 << depth) - 1
    feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
    low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
    node = np.zeros(len(codes), dtype=np.int64)
    for i in range(inner):
        here = np.flatnonzero(node == i)
        best = _best_split(codes[here], cuts, grad[here], hess[here], monotone, bins, smooth, least, low[i], high[i])
        left, right = 2 * i + 1, 2 * i + 2
        low[left] = low[right] = low[i]
        high[left] = high[right] = high[i]
        if best is not None:
            f, cut, a, b = best
            feature[i], threshold[i] = f, cuts[f][cut]
            if monotone[f]:
                middle = (a + b) / 2
                (high if monotone[f] > 0 else low)[left] = middle
                (low if monotone[f] > 0 else high)[right] = middle
            node[here] = np.where(codes[here, f] > cut, right, left)
        else:
            node[here] = left
    value = np.zeros(inner + 1)
    for leaf in range(inner + 1):
        here = node == inner + leaf
        value[leaf] = np.clip(grad[here].sum() / (hess[here].sum() + smooth), low[inner + leaf], high[inner + leaf])
    return feature, threshold, value


def _best_split(codes, cuts, grad, hess, monotone, bins, smooth, least, low, high):
    best, found = 1e-6, None
    whole_g, whole_h = grad.sum(), hess.sum()
    stay = whole_g**2 / (whole_h + smooth)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        g = np.cumsum(np.bincount(codes[:, f], grad, minlength=len(edges) + 1))[:-1]
        h = np.cumsum(np.bincount(codes[:, f], hess, minlength=len(edges) + 1))[:-1]
        a = np.clip(g / (h + smooth), low, high)
        b = np.clip((whole_g - g) / (whole_h - h + smooth), low, high)
        gain = 2 * a * g - a**2 * (h + smooth) + 2 * b * (whole_g - g) - b**2 * (whole_h - h + smooth) - stay
        gain[(h < least) | (whole_h - h < least) | (monotone[f] * (b - a) < 0)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (f, k, a[k], b[k])
    return found
