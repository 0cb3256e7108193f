"""Removal of repeated word windows by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to its bucket
(``buckets``), where sorting counts windows exactly: words are numbered, and windows get numbers
by pairs of shorter ranges' numbers, which double until they cover a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .base import Block
from .buckets import Shape, dense, edges, later_windows, mark, spans

_U = np.uint64
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def window_numbers(words: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """Equal windows of ``size`` numbered words get equal numbers."""
    ids, span = words, 1
    while span * 2 <= size:
        later = np.zeros_like(ids)
        later[: len(ids) - span] = ids[span:]
        ids = dense((ids << _U(32)) | later)
        span *= 2
    if span == size:
        return ids[starts]
    return dense((ids[starts] << _U(32)) | ids[starts + (size - span)])


def _without(text: bytes, starts: np.ndarray, gone: np.ndarray, removed: int) -> bytes:
    """The text without some words, each with the white space up to the next."""
    if not removed:
        return text
    ends = np.append(starts[1:], len(text))
    out = [text[: starts[0]]]
    for a, b in zip(*edges(~gone, np.array([0, len(gone)])), strict=True):
        out.append(text[starts[a] : ends[b - 1]])
    return b"".join(out)


def remove_repeated_words(docs: DataFrame, length: int = 20, gram: int = 4, carry: Column | None = None, spread: int = 4096, spacing: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``length`` words that also starts earlier.

    ``gram``: words of a minimiser; ``spread``: buckets of more strings are dealt out by window.
    Earlier: in a smaller doc_id, or at a smaller place of the same document.  Windows are
    judged on the input, and compared word by word.

    Returns doc_id, n_words, n_removed and the kept words joined by one space; with ``spacing`` the
    text itself without the removed words and the white space behind them (a null text, like one of
    which no word is left, gives an empty one).  A null or empty text has no words; a text of fewer than ``length`` words loses none.  Rows with one
    doc_id count as one document, in which equal places are not earlier than each other; a
    null doc_id is smaller than any other.  ``carry`` is returned with its row.  An empty table
    gives an empty result.
    """
    shape = Shape(length, gram, True, True)

    def refine(texts: list[bytes], ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        seen: dict[bytes, int] = {}
        lists = [t.split(b" ") for t in texts]
        words = np.array([seen.setdefault(w, len(seen)) for x in lists for w in x], _U)
        begin = np.cumsum([0, *map(len, lists)])[:-1]
        of = np.repeat(np.arange(len(texts)), count)
        win = window_numbers(words, length, spans(begin, begin + count))
        return later_windows(win, ids[of], spans(first, first + count), shape)

    def finish(block: Block, parts: Iterator[tuple]) -> pa.Table:
        total, removed, kept = [], [], []
        for a, _, off, covered, (starts, _) in parts:
            sums = np.concatenate([[0], np.cumsum(covered)])
            total.append(np.diff(off))
            removed.append(np.diff(sums[off]))
            for i, (r, n) in enumerate(zip(removed[-1].tolist(), total[-1].tolist(), strict=True)):
                if r == n:
                    kept.append(b"")
                    continue
                if spacing:
                    kept.append(_without(block.text(a + i), starts[off[i] : off[i + 1]] - (block.off[a + i] - block.off[a]), covered[off[i] : off[i + 1]], r))
                    continue
                w = block.text(a + i).split()
                kept.append(b" ".join(w if not r else [w[k] for k in np.flatnonzero(~covered[off[i] : off[i + 1]]).tolist()]))
        flat = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (total, removed)]
        return pa.table([block.id_column(), *flat, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return mark(docs, shape, refine, finish, SCHEMA, carry, spread)
