"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(f))]
        return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Newton boosting on the logistic loss; splits at quantile bins of each feature."""
    n, p = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(n, base)
    inner = (1 << depth) - 1
    features, thresholds, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, prob * (1 - prob)
        at = np.zeros(n, np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for d in range(depth):
            first = (1 << d) - 1
            width = 1 << d
            held = (at - first) * bins
            gs, hs = np.empty((width, p, bins)), np.empty((width, p, bins))
            for j in range(p):
                key = held + binned[j]
                gs[:, j] = np.bincount(key, g, width * bins).reshape(width, bins)
                hs[:, j] = np.bincount(key, h, width * bins).reshape(width, bins)
            gs, hs = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    f[first + k], t[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - inner
        gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        v = rate * gl / (hl + ridge)
        score += v[leaf]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    return Boosted(base, np.stack(features), np.stack(thresholds), np.stack(values), depth)
