"""A cuckoo filter over 64-bit key hashes, built and probed with whole arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Odd 64-bit multiplier of the mixing step.
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints (0: free); each key has two buckets, each computable from the other.

    Insertion places all keys at once: every round, pending keys take free slots of their bucket; those that
    found none swap with a resident, which then tries its other bucket. Deletion removes one equal fingerprint.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def for_keys(cls, n: int, load: float = 0.8) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, n) / (SLOTS * load))))))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mix(hashes.astype(np.uint64, copy=False))
        prints = (mixed & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (mixed >> np.uint64(16)) & np.uint64(self.buckets - 1)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (_mix(prints.astype(np.uint64) + np.uint64(1)) & np.uint64(self.buckets - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, a = self._places(hashes)
        b = self._other(prints, a)
        p = prints[:, None]
        return (self.table[a] == p).any(axis=1) | (self.table[b] == p).any(axis=1)

    def _settle(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put what fits in free slots of the given buckets; the mask of those that were put."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        first = np.r_[0, np.flatnonzero(np.diff(sorted_at)) + 1]
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        free = self.table[sorted_at] == 0
        fits = rank < free.sum(axis=1)
        slot = (np.cumsum(free, axis=1) == (rank + 1)[:, None]).argmax(axis=1)
        self.table[sorted_at[fits], slot[fits]] = prints[order][fits]
        put = np.zeros(len(at), bool)
        put[order[fits]] = True
        return put

    def insert(self, hashes: np.ndarray, rounds: int = 500) -> bool:
        """Insert keys, one fingerprint each; False if the filter is too full (then build a larger one anew)."""
        prints, at = self._places(hashes)
        put = self._settle(prints, at)
        prints, at = prints[~put], at[~put]
        at = self._other(prints, at)
        for turn in range(rounds):
            put = self._settle(prints, at)
            prints, at = prints[~put], at[~put]
            if not len(prints):
                return True
            # One pending key a bucket swaps with a resident; the others wait in place.
            _, one = np.unique(at, return_index=True)
            slot = (turn + np.arange(len(one))) % SLOTS
            out = self.table[at[one], slot].copy()
            self.table[at[one], slot] = prints[one]
            prints[one] = out
            at[one] = self._other(out, at[one])
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Remove one fingerprint for each key; keys must have been inserted."""
        prints, a = self._places(hashes)
        b = self._other(prints, a)
        for p, x, y in zip(prints, a, b, strict=True):
            for at in (x, y):
                where = np.flatnonzero(self.table[at] == p)
                if len(where):
                    self.table[at, where[0]] = 0
                    break


def built(hashes: np.ndarray) -> CuckooFilter:
    """A filter that holds all keys, of as many buckets as that takes."""
    size = len(hashes)
    while True:
        out = CuckooFilter.for_keys(size)
        if out.insert(hashes):
            return out
        size *= 2
