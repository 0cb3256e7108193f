"""A cuckoo filter on numpy arrays: batches of insertions, look-ups and deletions."""

from __future__ import annotations

import numpy as np

from .base import mix

_U = np.uint64
SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints of 64-bit keys in buckets of four.

    A key that was added is always found; another key is found with a chance of about
    2 * SLOTS / 2**16.  ``remove`` takes out one fingerprint of a key that was added.  What
    finds no place after ``KICKS`` rounds goes to a spill list, so nothing is ever lost.
    """

    KICKS = 64

    def __init__(self, capacity: int):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.8)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.spill = np.zeros(0, _U)
        self._random = np.random.default_rng(7)

    @classmethod
    def of(cls, table: np.ndarray, spill: np.ndarray) -> CuckooFilter:
        """A filter from what another held."""
        out = cls(0)
        out.table, out.spill = table.reshape(-1, SLOTS).copy(), spill
        out.buckets = len(out.table)
        return out

    @property
    def capacity(self) -> int:
        """How many keys it holds well."""
        return int(self.buckets * SLOTS * 0.8)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys + _U(0x632BE59BD9B4E019))
        print_ = ((h >> _U(48)).astype(np.uint16) % np.uint16(65535)) + np.uint16(1)
        first = (h & _U(self.buckets - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(_U)) & _U(self.buckets - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        found = ((self.table[a] == p[:, None]) | (self.table[b] == p[:, None])).any(1)
        return found | np.isin(self._code(p, a, b), self.spill) if len(self.spill) else found

    def _code(self, print_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the spill list holds: a fingerprint and the smaller of its buckets."""
        return (print_.astype(_U) << _U(48)) | np.minimum(a, b).astype(_U)

    def _put(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put what fits into the free slots of its bucket; which did not fit."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        start = np.r_[True, b[1:] != b[:-1]]
        nth = np.arange(len(b)) - np.maximum.accumulate(np.where(start, np.arange(len(b)), 0))
        free = self.table[b] == 0
        fits = nth < free.sum(1)
        slot = np.argmax(np.cumsum(free, 1) == (nth + 1)[:, None], 1)
        self.table[b[fits], slot[fits]] = print_[order[fits]]
        return order[~fits]

    def add(self, keys: np.ndarray) -> None:
        """Add keys; a fingerprint that is there already is there once more."""
        p, a, b = self._places(keys)
        left = self._put(p, a) if len(keys) else np.zeros(0, np.int64)
        left = left[self._put(p[left], b[left])] if len(left) else left
        # Fingerprints without a place push out others, which go to their other bucket.
        p, at = p[left], b[left]
        for _ in range(self.KICKS):
            if not len(p):
                return
            one = np.unique(at, return_index=True)[1]
            rest = np.setdiff1d(np.arange(len(at)), one)
            slot = self._random.integers(0, SLOTS, len(one))
            pushed = self.table[at[one], slot]
            self.table[at[one], slot] = p[one]
            ok = pushed > 0
            p, at = np.r_[pushed[ok], p[rest]], np.r_[self._other(at[one], pushed)[ok], at[rest]]
            if len(p):
                stay = self._put(p, at)
                p, at = p[stay], at[stay]
        if len(p):
            self.spill = np.r_[self.spill, self._code(p, at, self._other(at, p))]

    def remove(self, keys: np.ndarray) -> None:
        p, a, b = self._places(keys)
        codes = self._code(p, a, b)
        for k in range(len(keys)):
            if len(held := np.flatnonzero(self.spill == codes[k])):
                self.spill = np.delete(self.spill, held[0])
                continue
            for at in (a[k], b[k]):
                hit = np.flatnonzero(self.table[at] == p[k])
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break
