"""A cuckoo filter over 128-bit keys: insertions, deletions and membership on numpy arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 400
HEAD = 8


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in either of its two buckets."""

    def __init__(self, buckets: int):
        self.table = np.zeros((1 << max(1, int(buckets - 1).bit_length()), SLOTS), np.uint16)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(max(2, -(-keys * 2 // SLOTS)))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls(2)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = ((k1.astype(np.uint64) >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.int64)
        prints = np.where(prints == 0, 1, prints)
        mask = len(self.table) - 1
        first = (k2.astype(np.uint64) & np.uint64(mask)).astype(np.int64)
        return prints, first, first ^ (prints * 0x5BD1E995 & mask)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(k1, k2)
        prints = prints[:, None].astype(np.uint16)
        return (self.table[first] == prints).any(1) | (self.table[second] == prints).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Add keys that are not in yet; False when one finds no place (then build anew, larger)."""
        mask = len(self.table) - 1
        for mark, one, two in zip(*self._places(k1, k2)):
            for kick in range(KICKS):
                free = np.flatnonzero(self.table[one] == 0)
                if not len(free):
                    one, two = two, one
                    free = np.flatnonzero(self.table[one] == 0)
                if len(free):
                    self.table[one, free[0]] = mark
                    break
                slot = (kick + int(mark)) % SLOTS
                mark, self.table[one, slot] = int(self.table[one, slot]), mark
                two = one ^ (mark * 0x5BD1E995 & mask)
                one, two = two, one
            else:
                return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take out keys that are in; the caller's exact table says which are."""
        for mark, one, two in zip(*self._places(k1, k2)):
            for bucket in (one, two):
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
