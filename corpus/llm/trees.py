"""Gradient-boosted trees with monotonic constraints, grown on histograms in numpy and flattened to node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees one after the other; a leaf has feature -1. roots: the first node of each tree."""

    feature: np.ndarray
    edge: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; all rows walk down a tree together."""
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.maximum(self.feature[at], 0)
                at = np.where(inner, np.where(x[rows, f] >= self.edge[at], self.high[at], self.low[at]), at)
            out += self.value[at]
        return out

    def least(self, feature: int, bound: float) -> float:
        """No row whose feature has at least the bound scores less than this, whatever its other features."""

        def walk(k: int) -> float:
            if self.feature[k] < 0:
                return float(self.value[k])
            down, up = (self.low[k], self.high[k])
            return walk(up) if self.feature[k] == feature and bound >= self.edge[k] else min(walk(down), walk(up))

        return self.prior + sum(walk(r) for r in self.roots)


def fit(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], direction: list[int], rounds: int = 12, depth: int = 3, rate: float = 0.5, l2: float = 1.0) -> Trees:
    """Trees for log loss. edges: the bin edges of each feature; direction: 1 if the score may only rise with it, -1 only fall, 0 free.

    A split of a constrained feature counts only if its halves' values are in order, and what is grown below it stays on
    its side of their mean, so that the sum of all trees is monotonic.
    """
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    raw = np.full(len(y), prior)
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, floor: float, ceiling: float) -> int:
        k = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), floor, ceiling))
        nodes.append([-1, 0.0, 0, 0, rate * value])
        best = None
        if level < depth and len(rows) > 1:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                sums = [np.cumsum(np.bincount(bins[f][rows], w[rows], len(e) + 1))[:-1] for w in (g, h)]
                count = np.cumsum(np.bincount(bins[f][rows], minlength=len(e) + 1))[:-1]
                gl, hl = sums
                gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                vl, vr = np.clip(-gl / (hl + l2), floor, ceiling), np.clip(-gr / (hr + l2), floor, ceiling)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2)
                gain[(count == 0) | (count == len(rows)) | (direction[f] * (vr - vl) < 0)] = -np.inf
                j = int(np.argmax(gain))
                if gain[j] > (best[0] if best else g[rows].sum() ** 2 / (h[rows].sum() + l2) + 1e-9):
                    best = (gain[j], f, j, vl[j], vr[j])
        if best:
            _, f, j, vl, vr = best
            mid, up = (vl + vr) / 2, bins[f][rows] > j
            bounds = {1: ((floor, mid), (mid, ceiling)), -1: ((mid, ceiling), (floor, mid)), 0: ((floor, ceiling),) * 2}[direction[f]]
            low = grow(rows[~up], g, h, level + 1, *bounds[0])
            high = grow(rows[up], g, h, level + 1, *bounds[1])
            nodes[k] = [f, edges[f][j], low, high, 0.0]
        return k

    for _ in range(rounds):
        if not len(y):
            break
        p = 1 / (1 + np.exp(-raw))
        root = grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf)
        roots.append(root)
        raw += Trees(*_arrays(nodes), np.array([root]), 0.0).score(x)
    return Trees(*_arrays(nodes), np.array(roots, np.int64), prior)


def _arrays(nodes: list[list[float]]) -> list[np.ndarray]:
    a = np.array(nodes or [[-1, 0, 0, 0, 0]], np.float64)
    return [a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]]
