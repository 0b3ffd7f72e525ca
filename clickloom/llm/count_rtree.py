"""An R-tree over count vectors, joined with itself under a bound on overlap."""

from __future__ import annotations

import numpy as np

FANOUT = 16


def _pack(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order in which neighbours are alike: by size, then within runs by the coordinate that varies most."""
    order = np.argsort(sizes, kind="stable")
    run = FANOUT * FANOUT
    for lo in range(0, len(order), run):
        some = order[lo : lo + run]
        axis = int(np.argmax(points[some].var(axis=0)))
        order[lo : lo + run] = some[np.argsort(points[some, axis], kind="stable")]
    return order


class CountTree:
    """Points (group counts of sets) under boxes; a box keeps the least and largest count per group."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = _pack(points, sizes)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # of (largest counts, least size, largest size), from the leaves up
        high, least, most = self.points, self.sizes, self.sizes
        while len(least) > 1:
            at = np.arange(0, len(least), FANOUT)
            high, least, most = np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((high, least, most))

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """The points whose set may have a Jaccard similarity of num/den with the given set, and their bounds.

        Two sets share at most the sum of the smaller of their counts in each
        group; a box allows as much as its largest counts.
        """
        nodes = np.zeros(1, np.int64)
        for high, least, most in reversed(self.levels):
            nodes = nodes[nodes < len(least)]
            bound = np.minimum(high[nodes], point).sum(axis=1)
            near = (num * least[nodes] <= den * size) & (num * size <= den * most[nodes])
            keep = near & ((num + den) * bound >= num * (np.maximum(least[nodes], -(-num * size // den)) + size))
            nodes = (nodes[keep][:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
        nodes = nodes[nodes < len(self.sizes)]
        bound = np.minimum(self.points[nodes], point).sum(axis=1)
        enough = (num + den) * bound >= num * (self.sizes[nodes] + size)
        return self.order[nodes[enough]], bound[enough]
