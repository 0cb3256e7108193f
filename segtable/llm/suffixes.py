"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Every suffix of the corpus starts in the bucket of a q-gram: that at the minimiser of its first
``length`` bytes.  A suffix that is alone in its bucket is done (``buckets``).  The text of the other
buckets is sorted: its suffixes get the bucket pointers of their first eight bytes; then each
bucket with several suffixes is refined by sorting these on the bucket pointers of the suffixes
``span`` bytes later.  As those pointers are refined already, a round doubles what they cover, and its
updates are what the next round sorts on.  Suffixes that become alone take no further part.
Once pointers cover ``length`` bytes, a bucket holds equal strings, and its smallest doc_id keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import Block
from .buckets import Shape, edges, firsts, later_windows, mark, spans

_U = np.uint64
SCHEMA = "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"


def pointers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pointers: where the bucket of each key begins in sorted order; and which buckets hold several."""
    order = np.argsort(keys)
    new = firsts((keys[order],))
    begin = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    out = np.empty(len(keys), np.int64)
    out[order] = begin[which]
    many = np.empty(len(keys), bool)
    many[order] = (np.diff(np.append(begin, len(keys))) > 1)[which] if len(keys) else many
    return out, many


def refined(pointer: np.ndarray, some: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Refine in place the buckets of the suffixes ``some`` by pointers of later suffixes; which of them aren't alone.

    A refined bucket begins within the old one, so pointers stay in the order of the suffixes.
    """
    if not len(some):
        return some
    order = np.lexsort((later, pointer[some]))
    old, by = pointer[some][order], later[order]
    start = np.flatnonzero(firsts((old,)))
    place = np.arange(len(old)) - np.repeat(start, np.diff(np.append(start, len(old))))
    new = firsts((old, by))
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(old)))
    pointer[some[order]] = old + np.repeat(place[head], size)
    return some[order][np.repeat(size > 1, size)]


def same_strings(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of the suffixes at ``starts`` when buckets are their first ``length`` bytes.

    ``buf`` has eight bytes of padding; no string that begins at ``starts`` reaches into it.
    """
    n = len(buf) - 8
    grams = np.ndarray((n,), "<u8", buf, 0, (1,))
    span = min(8, length)
    keys = np.array(grams) if span == 8 else grams & _U((1 << 8 * span) - 1)
    pointer, many = pointers(keys)
    while span * 2 <= length:
        some = np.flatnonzero(many)
        some = some[some + span < n]
        later = pointer[some + span]
        left = refined(pointer, some, later)
        many = np.zeros(n, bool)
        many[left] = True
        span *= 2
    if span < length:  # the last step overlaps
        some = starts[many[starts]]
        refined(pointer, some, pointer[some + length - span])
    return pointer[starts]


def remove_repeated_bytes(docs: DataFrame, length: int = 50, gram: int = 20, spread: int = 4096) -> DataFrame:
    """Remove each byte that lies in a ``length``-byte string which also starts in a smaller doc_id.

    ``gram``: bytes of a first bucket's q-gram; ``spread``: first buckets of more strings are dealt
    out by window (``buckets``).  Strings are judged on the input, and compared byte by byte.

    Returns doc_id, n_bytes, n_removed, the maximal removed runs as byte offsets (starts,
    ends) and the kept bytes, which need not be valid UTF-8.  A null or empty text has no
    bytes; a text shorter than ``length`` loses none.  Rows with one doc_id do not remove
    bytes from each other; a null doc_id is smaller than any other.  Other columns are not
    looked at.  An empty table gives an empty result.
    """
    shape = Shape(length, gram, False, False)

    def refine(texts: list[bytes], ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        buf = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        of = np.repeat(np.arange(len(texts)), count)
        win = same_strings(buf, spans(begin, begin + count), length)
        return later_windows(win, ids[of], spans(first, first + count), shape)

    def finish(block: Block, parts: Iterator[tuple]) -> pa.Table:
        removed, starts, ends, counts, kept = [], [], [], [], []
        for a, b, off, covered, _ in parts:
            begin, end = edges(covered, off)
            cut = np.searchsorted(begin, off)
            counts.append(np.diff(cut))
            base = np.repeat(off[:-1], np.diff(cut))
            starts.append(begin - base)
            ends.append(end - base)
            sums = np.concatenate([[0], np.cumsum(covered)])
            removed.append(np.diff(sums[off]))
            buf = block.buf[block.off[a] : block.off[b]]
            for i, r in enumerate(removed[-1].tolist()):
                x = block.text(a + i)
                kept.append(x if not r else buf[off[i] : off[i + 1]][~covered[off[i] : off[i + 1]]].tobytes() if r < len(x) else b"")
        at = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32) if counts else [0], pa.int32())
        runs = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (starts, ends)]
        return pa.table([block.id_column(), pa.array(np.diff(block.off)), pa.array(np.concatenate(removed) if removed else [], pa.int64()), *runs, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept"])

    return mark(docs, shape, refine, finish, SCHEMA, spread=spread)
