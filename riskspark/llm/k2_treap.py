"""A K2-treap: the non-empty cells of a grid as a compressed quadtree whose nodes hold the maximum below them.

A level's nodes stand in the order of their Morton codes, so a node needs a mask of its children and the place of the
first one. The path of a row through the tree goes on to the upper or the lower half of each node and may take either
half of its columns; several rows descend together, as one state per range of columns, bounded by the sum of the maxima of
their nodes. The state with the highest bound is opened next, so columns come out by descending sum.
"""

from __future__ import annotations

import heapq

import numpy as np

#: States opened at a time.
WAVE = 48


def _spread(x: np.ndarray) -> np.ndarray:
    """A zero before every bit of numbers below 2 ** 31."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
                        (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class K2Treap:
    """Cells (row, column, value), each place once, values positive."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        largest = max(int(rows.max(initial=0)), int(columns.max(initial=0)))
        self.height = max(largest.bit_length(), 1)
        codes = _spread(rows) << np.uint64(1) | _spread(columns)
        order = np.argsort(codes)
        codes, values = codes[order], values[order].astype(np.int64)
        # One more node a level, without children, stands for all empty ones.
        self.maxima, self.masks, self.first = [np.append(values, 0)], [], []
        for _ in range(self.height):
            quadrant, codes = (codes & np.uint64(3)).astype(np.uint8), codes >> np.uint64(2)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
            self.masks.append(np.append(np.bitwise_or.reduceat(np.uint8(1) << quadrant, starts) if len(starts) else quadrant,
                                        0).astype(np.uint8))
            self.first.append(np.append(starts, 0).astype(np.int32))
            values, codes = np.maximum.reduceat(values, starts) if len(starts) else values, codes[starts]
            self.maxima.append(np.append(values, 0))
        for levels in (self.maxima, self.masks, self.first):
            levels.reverse()

    def best(self, rows: np.ndarray, most: int, floor: int = 1) -> list[tuple[int, int]]:
        """(sum, column) of the columns with the highest sums over `rows`, at most `most` of them, none below `floor`
        or 1; by descending sum, equal sums by column."""
        floor = max(floor, 1)
        root = np.full(len(rows), 0 if len(self.maxima[0]) > 1 else -1)
        bound = int(self.maxima[0][root].sum())
        # (-bound, first column, level, nodes): the nodes of a leaf are not needed.
        todo = [(-bound, 0, 0, root)] if bound >= floor else []
        out: list[tuple[int, int]] = []
        leaves: list[int] = []
        while todo and len(out) < most:
            if todo[0][2] == self.height:
                bound, column, *_ = heapq.heappop(todo)
                out.append((-bound, column))
                continue
            waves: dict[int, list] = {}
            for _ in range(WAVE):
                if not todo or todo[0][2] == self.height or -todo[0][0] < floor:
                    break
                _, column, level, nodes = heapq.heappop(todo)
                waves.setdefault(level, []).append((column, nodes))
            if not waves:
                break
            for level, states in waves.items():
                nodes = np.stack([s[1] for s in states])
                mask, first = self.masks[level][nodes], self.first[level][nodes]
                half = (rows >> (self.height - 1 - level) & 1).astype(np.uint8) * np.uint8(2)
                width = 1 << (self.height - 1 - level)
                for side in (0, 1):
                    quadrant = half + np.uint8(side)
                    there = mask >> quadrant & 1
                    below = np.bitwise_count(mask & ((np.uint8(1) << quadrant) - np.uint8(1)))
                    children = np.where(there, first + below, len(self.maxima[level + 1]) - 1)
                    bounds = self.maxima[level + 1][children].sum(1)
                    for k in np.flatnonzero(bounds >= floor).tolist():
                        bound = int(bounds[k])
                        heapq.heappush(todo, (-bound, states[k][0] + side * width, level + 1, children[k]))
                        if level + 1 == self.height:
                            heapq.heappush(leaves, bound)
                            if len(leaves) > most:
                                heapq.heappop(leaves)
                                floor = max(floor, leaves[0])
        return out
