"""Variable-capacity best-fit packing of documents into sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .base import few, text_parts, written
from .buckets import spans

SCHEMA = "doc_id long, piece long, start long, length long, bin_id long, bin_capacity long, bin_offset long"


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the number of words of each whole text; null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_parts(batch.column(1))
            counts, a = [np.zeros(0, np.int64)], 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(off, off[a] + (4 << 20), "right")) - 1)
                counts.append(np.diff(K.words(buf[off[a] : off[b]], off[a : b + 1] - off[a])[2]))
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts), pa.int64())], names=["doc_id", "n"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n long")


def _fill(room: int, left: dict[int, int], mask: int) -> int:
    """How much of ``room`` the remaining lengths fill, the longest that fits first."""
    start, used = room, {}
    while room:
        size = (mask & ((1 << (room + 1)) - 1)).bit_length() - 1
        while size > 0 and used.get(size, 0) >= left[size]:
            size = (mask & ((1 << size) - 1)).bit_length() - 1
        if size <= 0:
            break
        count = min(room // size, left[size] - used.get(size, 0))
        used[size] = used.get(size, 0) + count
        room -= count * size
    return start - room


def bin_cost(capacity: int, overhead: int, attention: float) -> float:
    """What a sequence costs: its tokens, a fixed part, and attention, which grows with the square of its length."""
    return capacity + overhead + attention * capacity * capacity


def best_fit(lengths: Sequence[int], capacities: Sequence[int], overhead: int, attention: float = 0.0) -> tuple[list[int], list[int], list[int]]:
    """Bins for lengths in descending order: each item's bin and offset, and each bin's capacity.

    An item goes to the open bin that it leaves the least room in; of equal ones to that which got its
    last item latest.  If none has room, a bin is opened: of the capacities that hold the item, the one
    with the least ``bin_cost`` for what it can be filled with from the items to come; of equal
    ones the smaller.  In the end each bin is cut to the smallest capacity that holds its contents.
    """
    left: dict[int, int] = {}
    for x in lengths:
        left[x] = left.get(x, 0) + 1
    mask = sum(1 << x for x in left)
    rooms: dict[int, list[int]] = {}
    open_mask = 0
    used: list[int] = []
    size: list[int] = []
    bins, offsets = [], []
    for x in lengths:
        left[x] -= 1
        if not left[x]:
            mask &= ~(1 << x)
        fits = open_mask >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_mask &= ~(1 << room)
        else:
            cost = lambda c: bin_cost(c, overhead, attention) / max(1, x + _fill(c - x, left, mask))  # noqa: E731,B023
            size.append(min((c for c in capacities if c >= x), key=lambda c: (cost(c), c)))
            b, room = len(used), size[-1]
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += x
        rooms.setdefault(room - x, []).append(b)
        open_mask |= 1 << (room - x)
    return bins, offsets, [min(c for c in capacities if c >= u) for u in used]


def cheapest(lengths: Sequence[int], capacities: Sequence[int], overhead: int, attention: float) -> tuple[list[int], list[int], list[int]]:
    """The least-cost ``best_fit`` of all sets of permitted capacities that have the largest.

    A bin's capacity is chosen for the items to come, which a greedy choice can misjudge; so the
    choice among all capacities also competes with those among fewer.  Of equal ones the larger set.
    """
    caps = sorted(capacities)
    sets = sorted(([*(c for k, c in enumerate(caps[:-1]) if mask >> k & 1), caps[-1]] for mask in range(1 << (len(caps) - 1))), key=len, reverse=True)
    packed = [best_fit(lengths, some, overhead, attention) for some in sets]
    for k, (bins, offsets, _) in enumerate(packed):
        used = [0] * (max(bins) + 1 if bins else 0)
        for b, o, x in zip(bins, offsets, lengths, strict=True):
            used[b] = max(used[b], o + x)
        packed[k] = bins, offsets, [min(c for c in caps if c >= u) for u in used]  # cut to any permitted one
    return min(packed, key=lambda p: sum(bin_cost(c, overhead, attention) for c in p[2]))


def pack_sequences(lengths: DataFrame, capacities: Sequence[int] = (512, 1024, 2048), overhead: int = 16, attention: float = 2.0**-13, shard_docs: int = 16384) -> DataFrame:
    """Pack documents (doc_id, n) into sequences of the permitted lengths, at the least ``bin_cost``.

    A document longer than the largest capacity is cut into pieces of that size, which fill a
    bin each; what remains of it is packed like a short one.  Documents are dealt by a hash of
    their row into shards of about ``shard_docs``, each packed on its own (best fit, longest first, ties by
    doc_id), so work and memory of a task don't grow with the table, however often a doc_id is repeated.
    ``lengths`` is written once; the same files give the same bins.

    One row per piece: its place in the document, its bin and the bin's capacity, and its
    place in the bin.  A document of length 0 or null is one piece of length 0.  Repeated rows
    are packed each; a null doc_id is packed like any other.  An empty table gives no rows.
    """
    caps = sorted(set(capacities))
    top = caps[-1]
    given = written(few(lengths.select("doc_id", "n"), lengths))
    shards = max(1, math.ceil(given.count() / shard_docs))

    def run(table: pa.Table) -> pa.Table:
        base = int(table.column("shard")[0].as_py()) << 32
        raw = table.column("doc_id")
        missing = raw.is_null().to_numpy()
        ids = raw.fill_null(0).to_numpy()
        n = table.column("n").fill_null(0).to_numpy()
        rest = n % top
        short = np.flatnonzero((rest > 0) | (n == 0))
        short = short[np.lexsort((n[short], ids[short], missing[short], -rest[short]))]
        bins, offsets, of = cheapest(rest[short].tolist(), caps, overhead, attention)
        long = np.flatnonzero(n >= top)
        long = long[np.lexsort((n[long], ids[long], missing[long]))]
        place = spans(np.zeros(len(long), np.int64), n[long] // top)
        long = np.repeat(long, n[long] // top)
        row, piece = np.concatenate([short, long]), np.concatenate([n[short] // top, place])
        bin_ = np.concatenate([np.array(bins, np.int64), len(of) + np.arange(len(long))])
        columns = [
            pa.array(ids[row], pa.int64(), mask=missing[row]), piece, piece * top, np.concatenate([rest[short], np.full(len(long), top)]), base + bin_,
            np.array([*of, *[top] * len(long)], np.int64)[bin_], np.concatenate([np.array(offsets, np.int64), np.zeros(len(long), np.int64)]),
        ]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "piece", "start", "length", "bin_id", "bin_capacity", "bin_offset"])

    dealt = given.select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)
