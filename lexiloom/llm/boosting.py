"""Gradient-boosted trees for two classes, on binned features, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees as full arrays: node k has children 2k+1 and 2k+2; ``feature`` -1 marks a leaf."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    at: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, at, value in zip(self.feature, self.at, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > at[node]), node)
            out += value[node]
        return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Fit by Newton boosting of the logistic loss; splits are bin edges at quantiles of each feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    mean = np.average(y, weights=weight)
    model = Boosted(float(np.log(mean / (1 - mean))))
    margin = np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, at, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            here = np.flatnonzero(node >= first)
            if not len(here):
                break
            place = node[here] - first
            gain, choice = np.zeros(count), np.zeros((count, 2), np.int64)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = place * bins + binned[here, f]
                gs, hs = (np.bincount(key, w[here], count * bins).reshape(count, bins).cumsum(axis=1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                own = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                own[(hs < least) | (ht - hs < least)] = -1
                own[:, len(e) :] = -1
                k = own.argmax(axis=1)
                top = own[np.arange(count), k]
                better = top > gain + 1e-9
                gain[better] = top[better]
                choice[better] = np.column_stack([np.full(count, f), k])[better]
            split = gain > 0
            for k in np.flatnonzero(split):
                feature[first + k], at[first + k] = choice[k, 0], edges[choice[k, 0]][choice[k, 1]]
            go = split[place]
            moving = here[go]
            f = choice[place[go], 0]
            node[moving] = 2 * node[moving] + 1 + (binned[moving, f] > choice[place[go], 1])
        leaf = np.bincount(node, g, size) / (np.bincount(node, h, size) + ridge)
        value[:] = rate * leaf
        margin += value[node]
        model.feature.append(feature)
        model.at.append(at)
        model.value.append(value)
    return model
