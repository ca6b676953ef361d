"""Boosted trees for two classes in numpy: complete binary trees of a fixed depth, fitted to the logistic loss by Newton steps."""

from __future__ import annotations

import dataclasses

import numpy as np

ROWS = 2048


@dataclasses.dataclass
class Trees:
    feature: np.ndarray  # tree x inner node; the children of node i are 2 i + 1 and 2 i + 2
    cut: np.ndarray  # a row goes right if its feature is greater
    leaf: np.ndarray  # tree x leaf, times the learning rate
    bias: float
    slope: float = 1.0  # calibration: probability = sigmoid(slope * score + shift)
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        out, inner, width = np.full(len(x), self.bias), self.feature.shape[1], x.shape[1] if x.ndim == 2 else 0
        for low in range(0, len(x), ROWS):  # a block of rows stays in the processor's cache for all trees
            part = np.ascontiguousarray(x[low : low + ROWS])
            flat, base = part.ravel(), np.arange(len(part)) * width
            for f, c, leaf in zip(self.feature, self.cut, self.leaf):
                node = 1 + (part[:, f[0]] > c[0])
                while node[0] < inner:
                    node = 2 * node + 1 + (flat.take(base + f.take(node)) > c.take(node))
                out[low : low + ROWS] += leaf.take(node - inner)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.score(x) + self.shift)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 2.0, sample: float = 1.0, columns: float = 1.0, seed: int = 3) -> Trees:
    """Each split is the best over ``bins`` quantile cuts of every feature (or a random share of rows and columns a tree)."""
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])  # code <= b means x <= cut b
    inner, mean = 2**depth - 1, np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(mean / (1 - mean))))
    score = np.full(len(y), out.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        use = np.flatnonzero(random.random(len(y)) < sample) if sample < 1 else np.arange(len(y))
        among = [j for j in range(x.shape[1]) if len(cuts[j]) and (columns >= 1 or random.random() < columns)]
        own, own_g, own_h = codes[among][:, use], g[use], h[use]
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            local = node[use] - first
            for j, code in zip(among, own):
                n = len(cuts[j]) + 1
                key = local * n + code
                gs = np.bincount(key, own_g, width * n).reshape(width, n).cumsum(axis=1)
                hs = np.bincount(key, own_h, width * n).reshape(width, n).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < least) | (ht - hl < least)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for i in np.flatnonzero(top > best + 1e-9):
                    best[i] = top[i]
                    out.feature[t, first + i], out.cut[t, first + i] = j, cuts[j][k[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.cut[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf[use], g[use], inner + 1), np.bincount(leaf[use], h[use], inner + 1)
        out.leaf[t] = rate * gs / (hs + 1)
        score += out.leaf[t][leaf]
    return out


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift by Newton's method on held-out rows; targets are smoothed, so that separable rows give finite values."""
    s, n1, n0 = model.score(x), y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    a = np.stack([s, np.ones(len(s))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (target - p) - 1e-3 * (w - [1, 0]))
        w = w + np.clip(step, -1, 1)
    model.slope, model.shift = float(w[0]), float(w[1])
