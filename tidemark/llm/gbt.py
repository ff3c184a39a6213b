"""Gradient-boosted trees on a bounded table, in vector operations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Booster:
    """Log-odds of one class against the rest as a sum of depth-limited trees over binned features."""

    cuts: list[np.ndarray]
    #: Per tree: feature and bin of each inner node in heap order, and the values of the leaves.
    features: list[np.ndarray]
    bins: list[np.ndarray]
    leaves: list[np.ndarray]
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if not self.features:
            return out
        binned = _binned(x, self.cuts)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.bins, self.leaves):
            node = np.zeros(len(x), int)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (binned[feature[node], rows] > cut[node])
            out += leaf[node - len(feature)]
        return out


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]) if len(x) else np.zeros((len(cuts), 0), int)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Booster:
    """Newton boosting of the logistic loss; ``y`` is 0 or 1. Deterministic."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = _binned(x, cuts)
    width = BINS + 1
    keys = binned + np.arange(x.shape[1])[:, None] * width
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Booster(cuts, [], [], [], float(np.log(p0 / (1 - p0))))
    margin = np.full(len(y), model.start)
    inner = (1 << depth) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, int), np.full(inner, width)
        node = np.zeros(len(y), int)
        for n in range(inner):
            inside = np.flatnonzero(node == n)
            if len(inside) >= 2:
                feature[n], cut[n] = _split(keys[:, inside], g[inside], h[inside], x.shape[1], width, ridge)
            node[inside] = 2 * n + 1 + (binned[feature[n], inside] > cut[n])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        model.features.append(feature)
        model.bins.append(cut)
        model.leaves.append(value)
    return model


def _split(keys: np.ndarray, g: np.ndarray, h: np.ndarray, count: int, width: int, ridge: float) -> tuple[int, int]:
    """(feature, bin) of the best split into bins up to it and beyond; a bin beyond all if none gains."""
    flat, times = keys.ravel(), keys.shape[0]
    left_g = np.cumsum(np.bincount(flat, np.tile(g, times), count * width).reshape(count, width), axis=1)
    left_h = np.cumsum(np.bincount(flat, np.tile(h, times), count * width).reshape(count, width), axis=1)
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    gain[(left_h < 1e-9) | (all_h - left_h < 1e-9)] = 0
    best = int(gain.argmax())
    return (best // width, best % width) if gain.ravel()[best] > 1e-9 else (0, width)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 5.0) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits y: Newton's method with a pull to (1, 0), which few or wrong labels do not overcome."""
    w = np.array([1.0, 0.0])
    z = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (p - y) + ridge * (w - [1.0, 0.0]))
        w = w - np.clip(step, -1, 1)
    return float(w[0]), float(w[1])
