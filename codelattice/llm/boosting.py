"""Gradient boosted trees for two classes, on features cut into bins; small enough to travel with a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Complete trees of one depth: for each tree the tested feature and the bound of each inner node, and the leaves' values."""

    features: np.ndarray  # trees x inner nodes
    bounds: np.ndarray
    leaves: np.ndarray  # trees x leaves
    start: float
    slope: float = 1.0  # calibration of the score
    shift: float = 0.0
    threshold: float = 0.5

    def to_json(self) -> dict:
        bounds = [[None if np.isinf(b) else float(np.float32(b)) for b in t] for t in self.bounds]
        return {"features": self.features.tolist(), "bounds": bounds, "leaves": np.round(self.leaves, 6).tolist(), "start": round(self.start, 6), "slope": round(self.slope, 6), "shift": round(self.shift, 6), "threshold": self.threshold}

    @classmethod
    def from_json(cls, d: dict) -> Boosted:
        bounds = np.array([[np.inf if b is None else b for b in t] for t in d["bounds"]])
        return cls(np.array(d["features"]), bounds, np.array(d["leaves"]), d["start"], d["slope"], d["shift"], d["threshold"])

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, b, v in zip(self.features, self.bounds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            out += v[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.score(x) + self.shift, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, smooth: float = 2.0) -> Boosted:
    """Boosting of the logistic loss by Newton steps; splits by the gain in the bins' gradient sums."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    width = bins + 1
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    score = np.full(n, start)
    inner = 2**depth - 1
    features, bounds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    flat = binned + np.arange(m) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) < 8:
                    continue
                idx = flat[rows].ravel()
                gs = np.bincount(idx, np.repeat(g[rows], m), m * width).reshape(m, width).cumsum(1)
                hs = np.bincount(idx, np.repeat(h[rows], m), m * width).reshape(m, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                gain[(hs < 1) | (ht - hs < 1)] = -1
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, b] > 1e-3 and b < len(edges[j]):
                    features[t, k], bounds[t, k] = j, edges[j][b]
            right = x[np.arange(n), features[t, node]] > bounds[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        leaves[t] = rate * gs / (hs + smooth)
        score += leaves[t, leaf]
    return Boosted(features, bounds, leaves, start)


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> Boosted:
    """The model with a logistic curve and the threshold of best F1, both fitted on rows held out of the training."""
    s = model.score(x)
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        ga, gb = float((s * (p - target)).sum()) + 1e-3 * (a - 1), float((p - target).sum())
        haa, hab, hbb = float((w * s * s).sum()) + 1e-3, float((w * s).sum()), float(w.sum()) + 1e-6
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    a = max(a, 0.05)
    p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
    grid = np.linspace(0.1, 0.9, 33)
    f1 = [2 * ((p >= t) & (y > 0)).sum() / max(1, (p >= t).sum() + (y > 0).sum()) for t in grid]
    best = grid[np.flatnonzero(np.isclose(f1, max(f1)))]
    return Boosted(model.features, model.bounds, model.leaves, model.start, float(a), float(b), float(best[np.argmin(np.abs(best - 0.5))]))
