"""A k-d tree over a small table of points, asked by whole batches."""

from __future__ import annotations

import numpy as np

LEAF = 8
#: Queries that are walked together.
TOGETHER = 4096


class Tree:
    """Points in boxes split at their middle along the longest side.

    ``places`` are in the order that decides ties: of two points at one distance the
    earlier is nearer. Node 0 is the root; children follow their parent.
    """

    def __init__(self, places: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(places))
        low, high, child, span = [], [], [], []
        todo = [(0, len(places), -1)]
        while todo:
            first, end, parent = todo.pop()
            node = len(low)
            if parent >= 0:
                child[parent].append(node)
            inside = places[self.order[first:end]]
            low.append(inside.min(axis=0))
            high.append(inside.max(axis=0))
            child.append([])
            span.append((first, end))
            if end - first > leaf and (high[-1] > low[-1]).any():
                axis, middle = int(np.argmax(high[-1] - low[-1])), (end - first) // 2
                halves = np.argpartition(inside[:, axis], middle)
                self.order[first:end] = self.order[first:end][halves]
                todo += [(first + middle, end, node), (first, first + middle, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.child = np.array([c or [-1, -1] for c in child])
        self.first, self.end = np.array(span).T
        self.places = places[self.order]
        #: Distances to points that were worked out since the tree was made.
        self.evaluations = 0

    def _bound(self, points: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance to the box of a node, 0 inside."""
        gap = np.maximum(np.maximum(self.low[node] - points, points - self.high[node]), 0.0)
        return gap[:, 0] ** 2 + gap[:, 1] ** 2 + gap[:, 2] ** 2

    def _score(self, points: np.ndarray, query: np.ndarray, leaf: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Compare the queries with all points of their leaves and keep what is nearer."""
        sizes = self.end[leaf] - self.first[leaf]
        owner = np.repeat(query, sizes)
        slot = np.repeat(self.first[leaf] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        delta = self.places[slot] - points[owner]
        d2 = delta[:, 0] ** 2 + delta[:, 1] ** 2 + delta[:, 2] ** 2
        self.evaluations += len(d2)
        rank = self.order[slot]
        sort = np.lexsort((rank, d2, owner))
        heads = sort[np.flatnonzero(np.r_[True, owner[sort][1:] != owner[sort][:-1]])] if len(sort) else sort
        who = owner[heads]
        nearer = (d2[heads] < best[who]) | ((d2[heads] == best[who]) & (rank[heads] < at[who]))
        best[who[nearer]], at[who[nearer]] = d2[heads][nearer], rank[heads][nearer]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, squared distance) of the nearest point of each query."""
        best, at = np.full(len(points), np.inf), np.full(len(points), len(self.order))
        for low in range(0, len(points), TOGETHER):
            high = min(low + TOGETHER, len(points))
            self._walk(points[low:high], best[low:high], at[low:high])
        return at, best

    def _walk(self, points: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        query = np.arange(len(points))
        # Straight down to a leaf, so that every query has a distance to beat.
        node = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = self.child[node, 0] >= 0
            if not inner.any():
                break
            left, right = self.child[node[inner]].T
            node[inner] = np.where(self._bound(points[inner], left) <= self._bound(points[inner], right), left, right)
        seen = node
        self._score(points, query, node, best, at)
        # Then every box that is not farther than that; equal ones may hold an earlier point.
        node = np.zeros(len(points), dtype=np.int64)
        while len(query):
            near = self._bound(points[query], node) <= best[query]
            query, node = query[near], node[near]
            leaf = self.child[node, 0] < 0
            fresh = leaf & (node != seen[query])
            self._score(points, query[fresh], node[fresh], best, at)
            query, node = np.repeat(query[~leaf], 2), self.child[node[~leaf]].ravel()
