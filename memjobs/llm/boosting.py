"""Small gradient-boosted trees and isotonic calibration, for models fitted on a bounded sample.

Trees are plain arrays, so a fitted model is a few kilobytes and scores whole Arrow batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Boosted:
    """``trees``: (feature, threshold, value) arrays of complete binary trees of ``depth`` levels."""

    depth: int
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.margin(np.asarray(x, dtype=np.float64)))


def fit_boosted(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 48,
    ridge: float = 2.0,
    least: float = 2.0,
) -> Boosted:
    """Newton boosting of the logistic loss over quantile bins. Deterministic: ties go to the first feature and cut."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    model = Boosted(depth)
    if len(y) == 0 or y.min() == y.max():
        model.base = float(np.clip(4 * (2 * (y.mean() if len(y) else 0) - 1), -4, 4))
        return model
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(rate0 / (1 - rate0)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    # values that few rows have still need a cut of their own
    cuts = [c if len(c) > 3 else np.unique(np.concatenate([c, _middle(x[:, j], bins)])) for j, c in enumerate(cuts)]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    margin = np.full(len(y), model.base)
    first_leaf = 2**depth - 1
    for _ in range(trees):
        p = _logistic(margin)
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        feature = np.zeros(first_leaf, dtype=np.int64)
        threshold = np.full(first_leaf, np.inf)
        for level in range(depth):
            start, count = 2**level - 1, 2**level
            local = at - start
            best = np.full(count, 1e-9)
            cut = np.full(count, width)
            chosen = np.zeros(count, dtype=np.int64)
            for j in range(x.shape[1]):
                key = local * width + coded[:, j]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                ns = np.bincount(key, minlength=count * width).reshape(count, width).cumsum(axis=1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(ns < least) | (nt - ns < least)] = -1
                gain[:, len(cuts[j]) :] = -1
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best[better] = gain[np.arange(count), top][better]
                cut[better], chosen[better] = top[better], j
            for k in range(count):
                if cut[k] < width:
                    feature[start + k], threshold[start + k] = chosen[k], cuts[chosen[k]][cut[k]]
            at = 2 * at + 1 + (coded[np.arange(len(y)), chosen[local]] > cut[local])
        leaf = at - first_leaf
        value = (
            rate * np.bincount(leaf, g, first_leaf + 1) / (np.bincount(leaf, h, first_leaf + 1) + ridge)
        )
        model.trees.append((feature, threshold, value))
        margin += value[leaf]
    return model


def _middle(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) < 2:
        return np.array([])
    cut = (values[1:] + values[:-1]) / 2
    return cut[:: max(1, len(cut) // bins)]


@dataclass
class Isotonic:
    """A non-decreasing map from raw scores to probabilities, linear between its knots."""

    knots: np.ndarray
    values: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.knots, self.values)


def fit_isotonic(score: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
    """Pool-adjacent-violators; every block also counts ``prior`` half-hits, so no value is exactly 0 or 1."""
    if len(score) == 0:
        return Isotonic(np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of scores, hits, rows
    for s, t in zip(score[order], y[order], strict=True):
        blocks.append([s, float(t), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    knots = np.array([b[0] / b[2] for b in blocks])
    values = np.maximum.accumulate(np.array([(b[1] + prior / 2) / (b[2] + prior) for b in blocks]))
    return Isotonic(knots, values)
