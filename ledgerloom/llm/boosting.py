"""Gradient boosting on histograms, in numpy: trees for candidates and nodes, lookup tables for additive models.

Both are fitted on the driver, on samples of a documented bound; what is fitted is small and goes to the executors
with the functions that score.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of all bins but the last, at quantiles of the values."""
    v = np.unique(x)
    if len(v) <= bins:
        return (v[1:] + v[:-1]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


class Trees:
    """Boosted trees of one depth for a binary label."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 4.0, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        edges = [edges_of(x[:, k], self.bins) for k in range(f)]
        coded = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(mean / (1 - mean)))
        margin = np.full(n, self.start)
        inner, leaves, b = 2**self.depth - 1, 2**self.depth, self.bins + 1
        self.feature, self.bound, self.leaf = np.zeros((self.rounds, inner), np.int64), np.full((self.rounds, inner), np.inf), np.zeros((self.rounds, leaves))
        for r in range(self.rounds):
            p = sigmoid(margin)
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                for k in range(f):
                    if not len(edges[k]):
                        continue
                    at = node * b + coded[:, k]
                    left_g = np.cumsum(np.bincount(at, g, width * b).reshape(width, b), 1)
                    left_h = np.cumsum(np.bincount(at, h, width * b).reshape(width, b), 1)
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    right_g, right_h = all_g - left_g, all_h - left_h
                    gain = left_g**2 / (left_h + self.l2) + right_g**2 / (right_h + self.l2) - all_g**2 / (all_h + self.l2)
                    gain[(left_h < self.least / 4) | (right_h < self.least / 4)] = -1
                    gain = gain[:, : len(edges[k])]
                    cut = gain.argmax(1)
                    value = gain[np.arange(width), cut]
                    for j in np.flatnonzero(value > best):
                        best[j], self.feature[r, first + j], self.bound[r, first + j] = value[j], k, edges[k][cut[j]]
                at = first + node
                node = 2 * node + (x[np.arange(n), self.feature[r, at]] > self.bound[r, at])
            sum_g, sum_h = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.leaf[r] = -self.rate * sum_g / (sum_h + self.l2)
            margin += self.leaf[r, node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for r in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, self.feature[r, at]] > self.bound[r, at])
            out += self.leaf[r, node]
        return out


class Calibration:
    """Probabilities from margins by a logistic curve fitted on held-out rows, and the least margin that is precise enough."""

    def fit(self, margin: np.ndarray, y: np.ndarray, precision: float) -> Calibration:
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps
            p = sigmoid(a * margin + b)
            w = np.maximum(p * (1 - p), 1e-9)
            d = np.array([((p - y) * margin).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
            m = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(m, d)
            a, b = max(a - step[0], 0.05), b - step[1]
        self.a, self.b = float(a), float(b)
        order = np.argsort(-margin, kind="stable")
        share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(share >= precision)
        lowest = margin[order][good[-1]] if len(good) else np.inf
        self.threshold = float(max(self.probability(np.array([lowest]))[0] if np.isfinite(lowest) else 1.0, 0.5))
        return self

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * margin + self.b)


class Additive:
    """A generalised additive model with pairwise interactions.

    Features are boosted in turn, each step by a tree of three leaves over the bins of one feature; what the trees
    add up to is one lookup table a feature. Then the `pairs` pairs of features that explain most of what is left
    are boosted likewise, over grids of coarse bins. A score is a sum of table entries."""

    def __init__(self, rounds: int = 120, bins: int = 32, coarse: int = 8, pairs: int = 6, rate: float = 0.1, l2: float = 2.0):
        self.rounds, self.bins, self.coarse, self.n_pairs, self.rate, self.l2 = rounds, bins, coarse, pairs, rate, l2

    @staticmethod
    def _step(g: np.ndarray, h: np.ndarray, l2: float, splits: int = 2) -> np.ndarray:
        """The values of a tree with up to `splits` splits over ordered bins."""
        parts = [(0, len(g))]
        G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
        for _ in range(splits):
            best = (1e-9, None)
            for a, b in parts:
                if b - a < 2:
                    continue
                cut = np.arange(a + 1, b)
                lg, lh, rg, rh = G[cut] - G[a], H[cut] - H[a], G[b] - G[cut], H[b] - H[cut]
                gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - (G[b] - G[a]) ** 2 / (H[b] - H[a] + l2)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (a, int(cut[k]), b))
            if best[1] is None:
                break
            a, c, b = best[1]
            parts.remove((a, b))
            parts += [(a, c), (c, b)]
        out = np.zeros(len(g))
        for a, b in parts:
            out[a:b] = -(G[b] - G[a]) / (H[b] - H[a] + l2)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        n, f = x.shape
        self.edges = [edges_of(x[:, k], self.bins) if n else np.zeros(0) for k in range(f)]
        self.wide = [edges_of(x[:, k], self.coarse) if n else np.zeros(0) for k in range(f)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        if not n or y.min() == y.max():
            return self
        code, grid = self._codes(x)
        margin = np.full(n, self.start)

        def boost(codes: list[np.ndarray], shapes: list[tuple[int, ...]], tables: list[np.ndarray], rounds: int) -> None:
            nonlocal margin
            for _ in range(rounds):
                for c, shape, t in zip(codes, shapes, tables, strict=True):
                    p = sigmoid(margin)
                    size = int(np.prod(shape))
                    g, h = np.bincount(c, p - y, size).reshape(shape), np.bincount(c, p * (1 - p), size).reshape(shape)
                    if len(shape) == 1:
                        step = self._step(g, h, self.l2)
                    else:  # one split of the first feature, then one of the second on each side
                        rows = self._step(g.sum(1), h.sum(1), self.l2, 1)
                        cut = int(np.argmax(rows != rows[0])) if (rows != rows[0]).any() else len(rows)
                        step = np.zeros(shape)
                        for a, b in ((0, cut), (cut, len(rows))):
                            if a < b:
                                step[a:b] = self._step(g[a:b].sum(0), h[a:b].sum(0), self.l2, 1)
                    t += self.rate * step
                    margin = margin + self.rate * step.reshape(-1)[c]

        boost(code, [t.shape for t in self.tables], self.tables, self.rounds)
        p = sigmoid(margin)
        strength = []
        for i in range(f):
            for j in range(i + 1, f):
                shape = (len(self.wide[i]) + 1, len(self.wide[j]) + 1)
                c = grid[i] * shape[1] + grid[j]
                g, h = np.bincount(c, p - y, shape[0] * shape[1]), np.bincount(c, p * (1 - p), shape[0] * shape[1])
                strength.append((-float((g**2 / (h + self.l2)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(strength)[: self.n_pairs]]
        shapes = [(len(self.wide[i]) + 1, len(self.wide[j]) + 1) for i, j in self.pairs]
        self.grids = [np.zeros(s) for s in shapes]
        boost([grid[i] * s[1] + grid[j] for (i, j), s in zip(self.pairs, shapes, strict=True)], shapes, self.grids, self.rounds // 3)
        return self

    def _codes(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], [np.searchsorted(e, x[:, k]) for k, e in enumerate(self.wide)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        code, grid = self._codes(x)
        out = np.full(len(x), self.start)
        for c, t in zip(code, self.tables, strict=True):
            out += t[c]
        for (i, j), t in zip(self.pairs, self.grids, strict=True):
            out += t[grid[i], grid[j]]
        return sigmoid(out)
