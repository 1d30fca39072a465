"""Forests of BK-trees over fingerprints of one or more 64-bit words, in NumPy.

A node's children are keyed by their integer Hamming distance to it, so every
node below the edge of key k lies at distance k exactly from the edge's parent.
Two consequences, for links at ``radius`` or less:

* a query at distance d of a node follows only edges within [d - radius, d + radius];
* what hangs below an edge of key <= radius is linked to its parent whole; a query
  that links to the node need not follow those edges to reach the same component.

Queries run in growing batches. After each batch, subtrees whose nodes all belong
to one component are marked, and later queries of that component skip them. So a
large cluster of near copies, which has quadratically many links, costs few visits.

With a test of pairs the radius only finds candidates, and a pair is linked if it
passes too. Then no edge links by its key alone, and all within the range are followed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: (query, node) pairs compared at once; bounds memory.
FRONTIER = 1 << 20


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the rows of two (n, words) arrays."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """One BK-tree for each group; ``group`` must be sorted, and fingerprints distinct within a group."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        """``prints``: (n,) or (n, words) of uint64."""
        self.prints = prints.astype(np.uint64, copy=False)
        self.prints = self.prints[:, None] if prints.ndim == 1 else self.prints
        self.most = 64 * self.prints.shape[1]
        self.span = self.most + 1
        n = len(prints)
        first = np.ones(n, bool)
        first[1:] = group[1:] != group[:-1]
        starts = np.flatnonzero(first)
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        self.parent = np.full(n, -1, np.int64)
        self.key = np.zeros(n, np.int64)
        self.levels = [starts]
        open_, at = np.flatnonzero(~first), self.root[~first]
        while len(open_):
            d = distance(self.prints[open_], self.prints[at])
            _, lead, which = np.unique(at * self.span + d, return_index=True, return_inverse=True)
            child = open_[lead]
            self.parent[child], self.key[child] = at[lead], d[lead]
            self.levels.append(child)
            rest = np.ones(len(open_), bool)
            rest[lead] = False
            open_, at = open_[rest], child[which[rest]]
        edge = np.where(self.parent < 0, -1, self.parent * self.span + self.key)
        self.order = np.argsort(edge, kind="stable")
        self.edges = edge[self.order]

    def children(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``node``, child) for the edges whose keys lie within [low, high]."""
        lo = np.searchsorted(self.edges, node * self.span + np.clip(low, 0, self.most), "left")
        hi = np.searchsorted(self.edges, node * self.span + np.clip(high, 0, self.most), "right")
        count = np.where(low > self.most, 0, np.maximum(hi - lo, 0))
        which = np.repeat(np.arange(len(node)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return which, self.order[place]

    def components(self, radius: int, test: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """For each fingerprint the smallest index of its component under links of at most ``radius`` that pass ``test``."""
        n = len(self.prints)
        self.test = test
        self.comp = np.arange(n)
        near = (self.parent >= 0) & (self.key <= radius)
        hold = np.full(n, -1)
        for level in self.levels[1:]:  # the nearest edge above that is short holds what is below it
            up = self.parent[level]
            hold[level] = np.where(near[level], up, hold[up])
        held = np.flatnonzero(hold >= 0)
        self._link(held, hold[held])
        start, batch = 0, 256
        while start < n:
            uniform = self._uniform()
            q = np.arange(start, min(start + batch, n))
            self._query(q, radius, uniform)
            start, batch = start + batch, batch * 2
        return self.comp

    def _query(self, q: np.ndarray, radius: int, uniform: np.ndarray) -> None:
        todo = [(q, self.root[q])]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            open_ = ~(uniform[node] & (self.comp[node] == self.comp[q]))
            q, node = q[open_], node[open_]
            if not len(q):
                continue
            d = distance(self.prints[q], self.prints[node])
            hit = d <= radius
            self._link(q[hit], node[hit])
            which, child = self.children(node, np.where(hit & (self.test is None), radius + 1, d - radius), d + radius)
            if len(which):
                todo.append((q[which], child))

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        if self.test is not None:
            open_ = self.comp[a] != self.comp[b]
            a, b = a[open_], b[open_]
            passed = self.test(a, b)
            a, b = a[passed], b[passed]
        self._join(a, b)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Union of the components of a[i] and b[i], by hooking to the smaller label and shortening paths."""
        comp = self.comp
        while len(a):
            x, y = comp[a], comp[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(comp, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = comp[comp]
                if (up == comp).all():
                    break
                comp[:] = up

    def _uniform(self) -> np.ndarray:
        """Whether a node's subtree lies in one component."""
        out = np.ones(len(self.prints), bool)
        for level in reversed(self.levels[1:]):
            bad = level[~(out[level] & (self.comp[level] == self.comp[self.parent[level]]))]
            out[self.parent[bad]] = False
        return out
