"""R-trees over vectors of counts: which sets can share enough, and which of these do."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tessera.llm.blocks import spread

#: Points of a leaf.
LEAF = 32
#: Bytes of coordinates that are compared at once, and pairs of nodes that are held at once.
_CHUNK, _PAIRS = 16 << 20, 1 << 18


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of a and b items with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def merged(count: int, one: np.ndarray, two: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest point that each point reaches by the pairs, starting from the labels so far."""
    label = np.arange(count) if label is None else label.copy()
    while True:
        a, b = label[one], label[two]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            return label
        np.minimum.at(label, high[open_], low[open_])
        while (label != label[label]).any():
            label = label[label]


class CountTree:
    """A tree for each group of points (cell): its box is halved along its widest coordinate until LEAF points or fewer are left.

    A node is a run of points in the tree's order. It knows the largest count of each coordinate and the extreme sizes of its
    points; children lie inside their parent's box. The overlap of two sets is at most the sum over the coordinates of the smaller
    count; that of any point of one node with any of another is at most the sum of the smaller maxima.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, cells: np.ndarray, percent: int):
        """cells: the points' cells, ascending."""
        self.counts, self.sizes, self.percent = counts, sizes.astype(np.int64), percent
        new = np.concatenate([[True], cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, bool)
        edges = np.append(np.flatnonzero(new), len(cells))
        self.order, self.edges, self.children = np.arange(len(cells)), [edges], []
        while (np.diff(edges) > LEAF).any():
            wide = np.diff(edges) > LEAF
            ordered = counts[self.order]
            spans = np.maximum.reduceat(ordered, edges[:-1], axis=0) - np.minimum.reduceat(ordered, edges[:-1], axis=0)
            node = np.repeat(np.arange(len(wide)), np.diff(edges))
            along = np.where(wide[node], ordered[np.arange(len(node)), spans.argmax(axis=1)[node]], 0)
            self.order = self.order[np.lexsort((along, node))]  # stable: leaves stay as they are
            self.children.append(np.append(0, np.cumsum(1 + wide)))
            edges = np.sort(np.concatenate([edges, (edges[:-1] + np.diff(edges) // 2)[wide]]))
            self.edges.append(edges)
        ordered, own = counts[self.order], self.sizes[self.order]
        begins = [e[:-1] for e in self.edges]
        self.top = [np.maximum.reduceat(ordered, b, axis=0) if len(b) else ordered for b in begins]
        self.low, self.high = ([f.reduceat(own, b) if len(b) else own for b in begins] for f in (np.minimum, np.maximum))

    def _reach(self, vectors: np.ndarray, one: np.ndarray, two: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Where the summed coordinate minima of the rows one and two come to the least overlap."""
        out, step = np.zeros(len(one), bool), max(1, _CHUNK // max(1, vectors.shape[1] * vectors.itemsize))
        for k in range(0, len(one), step):
            part = slice(k, k + step)
            out[part] = np.minimum(vectors[one[part]], vectors[two[part]]).sum(axis=1, dtype=np.int64) >= least[part]
        return out

    def _close(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = needed(self.sizes[one], self.sizes[two], self.percent)
        fits = np.minimum(self.sizes[one], self.sizes[two]) >= least
        one, two, least = one[fits], two[fits], least[fits]
        close = self._reach(self.counts, one, two, least)
        return one[close], two[close]

    def _apart(self, level: int, label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether two nodes hold points that aren't connected yet."""
        begin, own = self.edges[level][:-1], label[self.order]
        low, high = np.minimum.reduceat(own, begin), np.maximum.reduceat(own, begin)
        return (low[one] != high[one]) | (low[two] != high[two]) | (low[one] != low[two])

    def _open(self, level: int, label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether points of the two nodes can share enough and aren't all connected already; a node with itself can."""
        low, high, percent = self.low[level], self.high[level], self.percent
        keep = (one == two) | (np.minimum(high[one], high[two]) * (100 + percent) >= percent * (low[one] + low[two]))
        keep &= self._apart(level, label, one, two)
        some = np.flatnonzero(keep & (one != two))
        a, b = one[some], two[some]
        keep[some] = self._reach(self.top[level], a, b, needed(low[a], low[b], percent))
        return keep

    def connect(self, verify: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """For each point the first point of its cell that it reaches by pairs that are close enough, and pass verify if given.

        Pairs that are connected already are not looked at; no pair between different components of a cell is left out.
        """
        label = np.arange(len(self.sizes))

        def link(at: np.ndarray, by: np.ndarray) -> None:
            nonlocal label
            one, two = self.order[at], self.order[by]
            open_ = label[one] != label[two]
            one, two = self._close(one[open_], two[open_])
            if verify is not None and len(one):
                good = verify(one, two)
                one, two = one[good], two[good]
            label = merged(len(label), one, two, label)

        leaves = self.edges[-1]
        place, last = np.arange(len(label)), np.repeat(leaves[1:], np.diff(leaves))
        for step in range(1, int(np.diff(leaves).max(initial=0))):
            at = place[place + step < last]
            link(at, at + step)

        def descend(level: int, one: np.ndarray, two: np.ndarray) -> None:
            """Pairs of nodes of a level (one <= two), down to the points."""
            for k in range(0, len(one), _PAIRS if level < len(self.children) else 1024):
                part = slice(k, k + (_PAIRS if level < len(self.children) else 1024))
                open_ = self._open(level, label, one[part], two[part])
                a, b = one[part][open_], two[part][open_]
                if not len(a):
                    continue
                if level < len(self.children):
                    first = self.children[level]
                    wide, other = first[a + 1] - first[a], first[b + 1] - first[b]
                    left = np.repeat(spread(first[a], wide), np.repeat(other, wide))
                    right = spread(np.repeat(first[b], wide), np.repeat(other, wide))
                    keep = left <= right
                    descend(level + 1, left[keep], right[keep])
                else:
                    a, b = a[a != b], b[a != b]  # points of one leaf have met
                    wide, other = leaves[a + 1] - leaves[a], leaves[b + 1] - leaves[b]
                    left = np.repeat(spread(leaves[a], wide), np.repeat(other, wide))
                    link(left, spread(np.repeat(leaves[b], wide), np.repeat(other, wide)))

        if self.children:
            roots = np.flatnonzero(np.diff(self.edges[0]) > LEAF)
            descend(0, roots, roots)
        return label
