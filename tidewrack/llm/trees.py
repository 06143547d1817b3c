"""Histogram decision trees in numpy: a boosted and a bagged ensemble."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees of one depth; node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right if the value is larger
    leaf: np.ndarray  # trees x leaves
    base: float

    def total(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out


def _bin(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1), edges


def _entries(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells of what is not in the first bin of its column: few, as most columns are mostly zero."""
    row, column = np.nonzero(bins)
    return row, column * BINS + bins[row, column]


def _grow(bins, edges, entries, g, h, depth: int, ridge: float, least: float, chooser, rate: float):
    """One tree that lowers sum(g * v + h * v^2 / 2) over leaf values v."""
    n, width = bins.shape
    row, place = entries
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(n, np.int64)
    for d in range(depth):
        first, count = 2**d - 1, 2**d
        cell = (at - first)[row] * (width * BINS) + place

        def summed(v, cell=cell, first=first, count=count):
            out = np.bincount(cell, v[row], count * width * BINS).reshape(count, width, BINS)
            out[:, :, 0] = np.bincount(at - first, v, count)[:, None] - out.sum(axis=2)
            return out.cumsum(axis=2)

        sg, sh = summed(g), summed(h)
        tg, th = sg[:, :, -1:], sh[:, :, -1:]
        gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
        gain[(sh < least) | (th - sh < least)] = 0
        gain[~chooser(count, width)] = 0
        best = gain.reshape(count, -1).argmax(axis=1)
        for node in range(count):
            f, b = divmod(int(best[node]), BINS)
            if gain[node, f, b] > 1e-9 and b < len(edges[f]):
                feature[first + node], threshold[first + node] = f, edges[f][b]
        bound = np.array([np.searchsorted(edges[f], t, side="left") if np.isfinite(t) else BINS for f, t in zip(feature[first : first + count], threshold[first : first + count], strict=True)])
        local = at - first
        at = 2 * at + 1 + (bins[np.arange(n), feature[at]] > bound[local])
    leaf = at - inner
    value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
    return feature, threshold, value * rate, leaf


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Gradient-boosted trees on the logistic loss; total() gives log odds."""
    bins, edges = _bin(x)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    entries, score, grown = _entries(bins), np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        f, t, v, leaf = _grow(bins, edges, entries, p - y, p * (1 - p), depth, ridge, 1.0, lambda count, width: np.ones((count, width), bool), rate)
        score += v[leaf]
        grown.append((f, t, v))
    return Trees(*(np.stack(z) for z in zip(*grown, strict=True)), base)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 8, seed: int = 1) -> Trees:
    """A random forest: bootstrap rows, and a random square root of the features at each split; total() gives the mean vote."""
    rng = np.random.default_rng(seed)
    bins, edges = _bin(x)
    entries = _entries(bins)
    share = max(1, round(np.sqrt(x.shape[1]) * 1.5)) / x.shape[1]
    grown = []
    for _ in range(trees):
        w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        f, t, v, _leaf = _grow(bins, edges, entries, -y * w, w, depth, 1e-3, 1.0, lambda count, width: rng.random((count, width)) < share, 1.0)
        grown.append((f, t, v / trees))
    return Trees(*(np.stack(z) for z in zip(*grown, strict=True)), 0.0)
