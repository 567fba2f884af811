"""Minimal perfect hashing of integer keys, in numpy.

Keys are thrown at a bit array about twice as large as their number. A key that is alone in its place sets the bit there;
the others go on to the next, smaller array. A key's number is the count of set bits before its own, so n keys have the
numbers 0..n-1 and cost about three bits each. Keys are kept in the order of their numbers, so that a lookup tells a key
of the set from any other.
"""

from __future__ import annotations

import numpy as np

from riskspark.llm.textblocks import mixed

#: Places per key left, and levels after which the few keys left are numbered by their order.
ROOM, LEVELS = 2, 24


class PerfectHash:
    """Numbers of distinct non-negative integers below 2 ** 63."""

    def __init__(self, sizes: list[int], bits: np.ndarray, keys: np.ndarray):
        self.sizes, self.bits, self.keys = sizes, bits, keys
        self.starts = np.concatenate([[0], np.cumsum([s // 64 for s in sizes])]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, words, order = np.unique(np.asarray(keys, np.int64)), [], [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-len(left) * ROOM // 64) * 64
            at = cls._place(left, level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            word = np.zeros(size // 64, np.uint64)
            np.bitwise_or.at(word, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            order.append(left[alone][np.argsort(at[alone])])
            sizes.append(size)
            words.append(word)
            left = left[~alone]
        order.append(left)  # in ascending order
        return cls(sizes, np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate(order).astype(np.int64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        drawn = mixed(keys.astype(np.uint64) * np.uint64(2 * LEVELS) + np.uint64(level))
        return (drawn % np.uint64(size)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that are not in the set."""
        keys = np.asarray(keys, np.int64)
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self._place(keys[open_], level, size)
            word = self.starts[level] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            here = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            found, word, bit = open_[here], word[here], bit[here]
            out[found] = self.before[word] + np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            open_ = open_[~here]
        rest = self.keys[self.before[-1]:]
        if len(rest) and len(open_):
            out[open_] = self.before[-1] + np.minimum(np.searchsorted(rest, keys[open_]), len(rest) - 1)
        out[(out >= 0) & (self.keys[out] != keys)] = -1
        return out
