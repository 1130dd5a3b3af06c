"""Gradient-boosted trees for yes / no answers, small enough to travel with a task."""

import numpy as np


class BoostedTrees:
    """Depth-limited trees on binned features under logistic loss, with calibrated probabilities."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.slope, self.shift = 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, k], steps)) for k in range(x.shape[1])]
        binned, features = self._binned(x), x.shape[1]
        cells = binned + np.arange(features) * self.bins
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            slope, curve = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, border = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins)
            for level in range(self.depth):
                for n in range(2**level - 1, 2**(level + 1) - 1):
                    rows = np.flatnonzero(node == n)
                    if len(rows) > 1:
                        feature[n], border[n] = self._split(cells[rows], slope[rows], curve[rows], features)
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] >= border[node])
            leaf = node - (2**self.depth - 1)
            g, h = (np.bincount(leaf, v, 2**self.depth) for v in (slope, curve))
            value = -self.rate * g / (h + self.smooth)
            self.grown.append((feature, border, value))
            score += value[leaf]
        return self

    def _split(self, cells, slope, curve, features):
        flat = cells.ravel()
        g, h = (np.bincount(flat, np.repeat(v, features), features * self.bins).reshape(features, self.bins).cumsum(axis=1)
                for v in (slope, curve))
        all_g, all_h = g[:, -1:], h[:, -1:]
        gain = g**2 / (h + self.smooth) + (all_g - g)**2 / (all_h - h + self.smooth) - all_g**2 / (all_h + self.smooth)
        at = int(np.argmax(gain))
        return (at // self.bins, at % self.bins + 1) if gain.flat[at] > 1e-9 else (0, self.bins)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.start)
        for feature, border, value in self.grown:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] >= border[node])
            score += value[node - (2**self.depth - 1)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """Fit slope and shift of the margin on rows that were held out (Platt scaling)."""
        m, t = self.margin(x), (y * (y.sum() + 1) / (y.sum() + 2) + (1 - y) / (len(y) - y.sum() + 2))
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))
            self.slope -= 0.1 * float(((p - t) * m).mean()) / max(1e-9, float((m * m).mean())) * 4
            self.shift -= 0.4 * float((p - t).mean())
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))
