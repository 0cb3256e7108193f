"""Vectorised text kernels over a byte buffer that holds many documents."""

from __future__ import annotations

import numpy as np

from .base import mix

_U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], _U)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, _U)
        a[0] = 1
        have = _powers[base] = np.multiply.accumulate(a)
    return have[:n]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other than white space) and each document's first word.

    ``off`` are the documents' offsets in ``buf``; a word ends with its document.
    """
    inside = ~WHITE[buf[: off[-1]]]
    begin, end = inside.copy(), inside.copy()
    if len(inside):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = off[(off > 0) & (off < off[-1])]
        begin[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word.  ``buf`` has eight bytes of padding behind the last word."""
    if not len(starts):
        return np.zeros(0, _U)
    at = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    size = ends - starts
    h = mix((at[starts] & _MASK[np.minimum(size, 8)]) + _U(_BASE) * size.astype(_U))
    k, rest = 8, np.flatnonzero(size > 8)
    while len(rest):
        left = size[rest] - k
        h[rest] = mix(h[rest] * _U(_BASE) + (at[starts[rest] + k] & _MASK[np.minimum(left, 8)]))
        k += 8
        rest = rest[left > 8]
    return h


class Rolling:
    """Hashes of any range of a sequence of symbols, by sums of symbol times power of position."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(symbols * powers(_BASE, n), out=self.sums[1:])
        self.inv = powers(_INV, n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inv[a] + (b - a).astype(_U))

    def grams(self, q: int) -> np.ndarray:
        n = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:-q]) * self.inv[:n]) if n > 0 else np.zeros(0, _U)


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    span = 1
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n]) if span < w else x[:n]


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts, and the length at the end."""
    if not len(x):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])


def super_windows(off: np.ndarray, size: int, q: int, roll: Rolling) -> tuple[np.ndarray, ...]:
    """Maximal runs of consecutive windows of ``size`` symbols that share a minimiser.

    ``off``: the documents' offsets in symbols.  Per run: document, first window, number of
    windows, hash of the minimising q-gram, hash of all symbols that the windows cover.
    Windows never cross documents; the leftmost of equal minimisers counts.
    """
    n = int(off[-1])
    room = np.maximum(np.diff(off) - size + 1, 0)
    docs = np.flatnonzero(room)
    empty = np.zeros(0, np.int64)
    if not len(docs):
        return empty, empty, empty, empty.astype(_U), empty.astype(_U)
    grams = roll.grams(q)
    bits = max(1, int(n).bit_length())
    low = _U((1 << bits) - 1)
    best = sliding_min((grams & ~low) | np.arange(len(grams), dtype=_U), size - q + 1)
    if len(docs) == len(room) == 1:
        at = np.arange(room[0])
    else:
        r = room[docs]
        at = np.arange(r.sum()) + np.repeat(off[docs] - (np.cumsum(r) - r), r)
    anchor = (best[at] & low).astype(np.int64)
    cut = runs(anchor)
    first, count = at[cut[:-1]], np.diff(cut)
    doc = np.searchsorted(off, first, "right") - 1
    return doc, first, count, grams[anchor[cut[:-1]]], roll.of(first, first + count + size - 1)
