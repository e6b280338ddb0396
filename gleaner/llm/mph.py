"""A minimal perfect hash over one shard of 128-bit keys, with compact value arrays.

Keys are pairs of 64-bit hashes. A cascade of bit levels places them: at each level
every remaining key points at one bit; keys alone on their bit stay there, the rest
go on to the next, smaller level. A key's number is the rank of its bit, so n keys
get the numbers 0..n-1. Foreign keys may land on a bit too; the stored 64-bit
fingerprint tells them apart.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
_U = np.uint64


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser, salted per level."""
    with np.errstate(over="ignore"):
        x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class PerfectHash:
    """Built from distinct keys (``keys`` addresses, ``prints`` confirms); ``find`` gives numbers or -1."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray):
        both = keys ^ mixed(prints, 0)
        self.levels: list[tuple[np.ndarray, int]] = []
        left, rank = both, 0
        while len(left):
            m = max(64, int(GAMMA * len(left)))
            at = (mixed(left, len(self.levels) + 1) % _U(m)).astype(np.int64)
            hits = np.bincount(at, minlength=m)
            alone = hits == 1
            # rank of each set bit; int32 positions stand for the bit vector and its rank index
            ranks = np.full(m, -1, np.int32)
            ranks[alone] = np.arange(rank, rank + int(alone.sum()), dtype=np.int32)
            self.levels.append((ranks, m))
            rank += int(alone.sum())
            left = left[~alone[at]]
        self.size = rank
        self.prints = np.empty(rank, np.uint64)
        self.prints[self._place(both)] = prints

    def _place(self, both: np.ndarray) -> np.ndarray:
        out = np.full(len(both), -1, np.int64)
        open_ = np.arange(len(both))
        for level, (ranks, m) in enumerate(self.levels, 1):
            if not len(open_):
                break
            found = ranks[(mixed(both[open_], level) % _U(m)).astype(np.int64)]
            out[open_] = found
            open_ = open_[found < 0]
        return out

    def arrange(self, keys: np.ndarray, prints: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The value array in number order for the keys this hash was built from."""
        out = np.empty(self.size, values.dtype)
        out[self._place(keys ^ mixed(prints, 0))] = values
        return out

    def find(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 for keys that were not indexed."""
        if not self.size:
            return np.full(len(keys), -1, np.int64)
        n = self._place(keys ^ mixed(prints, 0))
        return np.where((n >= 0) & (self.prints[np.maximum(n, 0)] == prints), n, -1)
