"""Gradient-boosted trees for two classes over a dense matrix, and isotonic calibration of their margins.

Both are fitted on the driver from a sample whose size the caller bounds; the fitted model is a few kilobytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Complete binary trees of one depth; a row goes right where its feature exceeds the threshold."""

    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: int = 5) -> Trees:
    """Histogram splits, Newton leaves, logistic loss. Without rows of both classes the model is the constant rate."""
    n, k = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    model = Trees(depth, float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    # zero is the usual value of a rate: what lies just above it must not share its bin
    cuts = [np.unique(np.concatenate([c, [0.0]])) if (x[:, j] == 0).any() else c for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    margin = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        inner = 2**depth - 1
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = node - first
            best = np.full(many, 1e-6)
            for j in range(k):
                key = at * width + binned[:, j]
                sums = [np.bincount(key, w, many * width).reshape(many, width).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = -1
                gain[:, len(cuts[j]) :] = -1
                top = gain.argmax(axis=1)
                value = gain[np.arange(many), top]
                for m in np.flatnonzero(value > best):
                    best[m], feature[first + m], threshold[first + m] = value[m], j, cuts[j][top[m]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        margin += leaf[at]
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.leaf.append(leaf)
    return model


@dataclass
class Isotonic:
    """A non-decreasing step function through pooled points, linear between them."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return np.interp(v, self.x, self.y)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; a block of n rows with s positives gets (s + 0.5 r) / (n + r), r = 0.1, so that scores
    stay apart from 0 and 1."""
    if not len(margin):
        return Isotonic(np.array([-8.0, 8.0]), np.array([0.0003, 0.9997]))
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # positives, rows, sum of margins
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, v = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + v]
    xs = np.array([v / n for _, n, v in blocks])
    ys = np.maximum.accumulate(np.array([(s + 0.05) / (n + 0.1) for s, n, _ in blocks]))
    return Isotonic(xs, ys)
