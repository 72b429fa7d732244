"""Small learners in numpy for tables that fit on the driver: boosted trees, boosted lookup tables, isotonic fit."""

from __future__ import annotations

import numpy as np

BINS = 32


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each column: bin = number of cut points below the value."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of finite or other values; NaN counts as 0."""
    x = np.nan_to_num(x, nan=0.0, posinf=1e300, neginf=-1e300)
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1) if len(edges) else np.zeros((len(x), 0), np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Trees:
    """Gradient-boosted trees of depth 3 for a 0/1 label, by second-order steps on binned columns."""

    def __init__(self, rounds: int = 80, rate: float = 0.15, ridge: float = 2.0, depth: int = 3):
        self.rounds, self.rate, self.ridge, self.depth, self.trees, self.start = rounds, rate, ridge, depth, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = edges_of(x)
        b, n_bins = binned(x, self.edges), BINS
        p = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        z, width = np.full(len(y), self.start), b.shape[1]
        for _ in range(self.rounds if len(y) else 0):
            p = sigmoid(z)
            g, h = weight * (y - p), weight * p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                k = 1 << level
                gains = np.zeros((k, width, n_bins))
                for f in range(width):
                    at = node * n_bins + b[:, f]
                    gs = np.bincount(at, g, k * n_bins).reshape(k, n_bins).cumsum(1)
                    hs = np.bincount(at, h, k * n_bins).reshape(k, n_bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gains[:, f] = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                best = gains.reshape(k, -1).argmax(1)
                feature, cut = best // n_bins, best % n_bins
                splits.append((feature, cut))
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((splits, value))
            z += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, z = binned(x, self.edges), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            z += value[node]
        return z


class Additive:
    """A generalised additive model with pairs: lookup tables that shallow trees are added to, feature by feature.

    A step on a feature is a tree of depth 2 on it alone, so at most 4 steps of a step function; a step on a pair is
    one cut of each. Pairs are those whose residuals gain most from a grid of 4 by 4 after the single features.
    """

    def __init__(self, rounds: int = 60, rate: float = 0.1, ridge: float = 5.0, pairs: int = 6):
        self.rounds, self.rate, self.ridge, self.n_pairs = rounds, rate, ridge, pairs

    def _steps(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Values by bin of a tree of depth 2 on one column, from sums by bin."""
        out = np.zeros(len(g))

        def cut(a: int, z: int) -> int:
            gs, hs = g[a:z].cumsum(), h[a:z].cumsum()
            gain = gs**2 / (hs + self.ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.ridge)
            return a + int(gain.argmax()) + 1

        mid = cut(0, len(g))
        for a, z in ((0, mid), (mid, len(g))):
            if a < z:
                at = cut(a, z)
                for i, j in ((a, at), (at, z)):
                    if i < j:
                        out[i:j] = g[i:j].sum() / (h[i:j].sum() + self.ridge)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Additive:
        self.edges = edges_of(x)
        b, width = binned(x, self.edges), x.shape[1]
        p = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
        self.start, self.single, self.pairs, self.double = float(np.log(p / (1 - p))), np.zeros((width, BINS)), [], []
        z = np.full(len(y), self.start)
        if not len(y):
            return self
        for _ in range(self.rounds):
            for f in range(width):
                p = sigmoid(z)
                step = self.rate * self._steps(np.bincount(b[:, f], weight * (y - p), BINS), np.bincount(b[:, f], weight * p * (1 - p), BINS))
                self.single[f] += step
                z += step[b[:, f]]
        p = sigmoid(z)
        g, h, gains = weight * (y - p), weight * p * (1 - p), []
        for i in range(width):
            for j in range(i):
                at = (b[:, i] // 8) * 4 + b[:, j] // 8
                gains.append((float((np.bincount(at, g, 16) ** 2 / (np.bincount(at, h, 16) + self.ridge)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]]
        self.double = [np.zeros((BINS, BINS)) for _ in self.pairs]
        for _ in range(self.rounds // 2):
            for (i, j), grid in zip(self.pairs, self.double):
                p = sigmoid(z)
                at = b[:, i] * BINS + b[:, j]
                gs = np.bincount(at, weight * (y - p), BINS * BINS).reshape(BINS, BINS).cumsum(0).cumsum(1)
                hs = np.bincount(at, weight * p * (1 - p), BINS * BINS).reshape(BINS, BINS).cumsum(0).cumsum(1)
                quarters = lambda s: (s, s[:, -1:] - s, s[-1:] - s, s[-1, -1] - s[:, -1:] - s[-1:] + s)
                gq, hq = quarters(gs), quarters(hs)
                k, m = np.unravel_index(sum(a**2 / (np.maximum(c, 0) + self.ridge) for a, c in zip(gq, hq)).argmax(), (BINS, BINS))
                v = [self.rate * a[k, m] / (max(c[k, m], 0) + self.ridge) for a, c in zip(gq, hq)]
                step = np.empty((BINS, BINS))
                step[: k + 1, : m + 1], step[: k + 1, m + 1 :], step[k + 1 :, : m + 1], step[k + 1 :, m + 1 :] = v
                grid += step
                z += step[b[:, i], b[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = binned(x, self.edges), np.full(len(x), self.start)
        for f, row in enumerate(self.single):
            z += row[b[:, f]]
        for (i, j), grid in zip(self.pairs, self.double):
            z += grid[b[:, i], b[:, j]]
        return sigmoid(z)


class Isotonic:
    """A rising step function from margins to rates, by pooling adjacent violators."""

    def fit(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
        blocks: list[list[float]] = []
        for m, v, w in sorted(zip(z.tolist(), y.tolist(), weight.tolist())):
            if blocks and blocks[-1][0] == m:
                blocks[-1][1] += v * w
                blocks[-1][2] += w
            else:
                blocks.append([m, v * w, w, m])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                _, s, w2, top = blocks.pop()
                blocks[-1][1] += s
                blocks[-1][2] += w2
                blocks[-1][3] = top
        # a weak prior keeps rates of small blocks off 0 and 1
        rate = (weight * y).sum() / max(weight.sum(), 1e-9) if len(z) else 0.5
        self.at = np.array([b[0] for b in blocks])
        self.value = np.maximum.accumulate(np.array([(b[1] + 0.5 * rate) / (b[2] + 0.5) for b in blocks])) if blocks else np.zeros(0)
        self.rate = float(rate)
        return self

    def rates(self, z: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(z), self.rate)
        return self.value[np.clip(np.searchsorted(self.at, z, "right") - 1, 0, len(self.at) - 1)]
