"""Gradient-boosted trees for a yes-or-no label, in numpy: full trees of a fixed depth over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    edges: list[np.ndarray]  # of each feature's bins
    feature: np.ndarray  # (trees, inner nodes)
    bound: np.ndarray  # bins above it go right
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = np.ascontiguousarray(self.bins(x))
        rows = np.arange(len(b))
        inner = self.feature.shape[1]
        out = np.full(len(b), self.base)
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(b), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (b[rows, feature[node]] > bound[node])
            out += leaf[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, damping: float = 4.0) -> Trees:
    """Minimise log loss by Newton steps; splits are by gain, leaves are damped."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(edges, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), 255), np.zeros((trees, 2**depth)), float(np.log(mean / (1 - mean))))
    b = model.bins(x).astype(np.int64)
    f = np.full(len(y), model.base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            own = node - first
            best, pick, cut_at = np.zeros(many), np.zeros(many, np.int64), np.full(many, 255)
            total_g, total_h = (np.bincount(own, v, many) for v in (g, h))
            for c in range(x.shape[1]):
                key = own * bins + b[:, c]
                left_g, left_h = (np.cumsum(np.bincount(key, v, many * bins).reshape(many, bins), axis=1) for v in (g, h))
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + damping) + right_g**2 / (right_h + damping) - (total_g**2 / (total_h + damping))[:, None]
                gain[(left_h < 1) | (right_h < 1)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(many), at]
                better = top > best + 1e-9
                best[better], pick[better], cut_at[better] = top[better], c, at[better]
            model.feature[k, first : first + many], model.bound[k, first : first + many] = pick, cut_at
            node = 2 * node + 1 + (b[np.arange(len(y)), pick[own]] > cut_at[own])
        own = node - (2**depth - 1)
        model.leaf[k] = rate * np.bincount(own, g, 2**depth) / (np.bincount(own, h, 2**depth) + damping)
        f += model.leaf[k][own]
    return model
