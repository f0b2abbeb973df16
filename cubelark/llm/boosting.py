"""Gradient-boosted trees for the logistic loss, in numpy, and isotonic calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``trees`` trees of ``depth`` levels over features cut into at most ``bins`` quantile bins."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.start = float(np.log(rate / (1 - rate)))
        f, self.fitted = np.full(len(y), self.start), []
        for _ in range(self.trees if len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.fitted.append(tree)
            f += self._apply(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1) if len(self.cuts) else np.zeros((len(x), 0), int)

    def _grow(self, b, g, h):
        """Complete tree: (feature, cut) by inner node in level order, values by leaf."""
        node, splits = np.zeros(len(g), np.int64), []
        width = self.bins + 1
        for level in range(self.depth):
            n = 1 << level
            best = np.full(n, 1e-6)
            feature, cut = np.zeros(n, np.int64), np.full(n, width, np.int64)
            for j in range(b.shape[1]):
                at = node * width + b[:, j]
                sg = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                sh = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sh < self.least) | (th - sh < self.least)] = 0
                k = gain.argmax(1)
                more = gain[np.arange(n), k] > best
                best[more], feature[more], cut[more] = gain[np.arange(n), k][more], j, k[more]
            splits.append((feature, cut))
            node = 2 * node + (b[np.arange(len(g)), feature[node]] > cut[node])
        leaves = 1 << self.depth
        value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        return splits, value

    def _apply(self, tree, b):
        node = np.zeros(len(b), np.int64)
        for feature, cut in tree[0]:
            node = 2 * node + (b[np.arange(len(b)), feature[node]] > cut[node])
        return tree[1][node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        for tree in self.fitted:
            f += self._apply(tree, b)
        return f


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: ascending margins and the calibrated probability from each on."""
    knots, merged = np.unique(margin, return_inverse=True)
    weight = np.bincount(merged).astype(float)
    mean = np.bincount(merged, y) / weight
    blocks: list[list[float]] = []
    for k, m, w in zip(knots, mean, weight):
        blocks.append([k, m, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            _, m2, w2 = blocks.pop()
            k1, m1, w1 = blocks.pop()
            blocks.append([k1, (m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
