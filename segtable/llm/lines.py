"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

A block of documents holds exact references (key, doc_id) and tells a key's shard how many of its
documents hold the key and which is the largest; a third of all documents with one line cost
one entry per block.  A shard has a cuckoo filter with one fingerprint per key, and a table of
reference counts per key and block.  A key that the filter doesn't know is new and needs no look-up;
others are looked up, so a false positive costs a look, not a line.  When a key's last
reference goes, so does its fingerprint: what was put in can be taken out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import NULL_ID, PACKED, Block, Net, blocks, carrying, deal, docs_of, few, mail, net, pack, payloads, unpack, written
from .buckets import both, firsts, shard_of
from .cuckoo import CuckooFilter

_U = np.uint64
STRIP = b" \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_lines long, n_dropped long, kept string"
COUNTS = "k1 long, k2 long, n_docs long, max_doc long"


def line_key(line: bytes, least: int) -> bytes | None:
    """The stripped line with A-Z in lower case, or None if it has fewer than ``least`` code points."""
    key = line.strip(STRIP).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return key


def references(block: Block, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, document) of a block: two 64-bit halves of the key's hash, and doc_id."""
    digests, ids = [], []
    for i, doc in enumerate(block.ids.tolist()):
        keys = {k for line in block.text(i).split(b"\n") if (k := line_key(line, least)) is not None}
        digests += map(xxhash.xxh3_128_digest, keys)
        ids += [doc] * len(keys)
    k = np.frombuffer(b"".join(digests), _U).reshape(-1, 2)
    return k[:, 0], k[:, 1], np.array(ids, np.int64)


def counted(k1: np.ndarray, k2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Reference counts of one block: key, number of distinct documents, largest document."""
    order = np.lexsort((ids, k2, k1))
    k1, k2, ids = k1[order], k2[order], ids[order]
    again = ~firsts((k1, k2, ids))
    k1, k2, ids = k1[~again], k2[~again], ids[~again]
    cut = np.flatnonzero(firsts((k1, k2)))
    return k1[cut], k2[cut], np.diff(np.append(cut, len(k1))), np.maximum.reduceat(ids, cut) if len(cut) else ids


class Shard:
    """One shard of the index: a filter of its keys, and their reference counts per block, in order of key and block."""

    def __init__(self, raw: bytes | None = None):
        if raw is None:
            z = np.zeros(0, np.int64)
            self.filter, self.k1, self.k2, self.block, self.count, self.largest = CuckooFilter(64), z.view(_U), z.view(_U), z, z, z
        else:
            table, spill, self.k1, self.k2, self.block, self.count, self.largest = unpack(raw)
            self.filter = CuckooFilter.of(table, spill)

    def packed(self) -> bytes:
        return pack(self.filter.table.ravel(), self.filter.spill, self.k1, self.k2, self.block, self.count, self.largest)

    def apply(self, told: list[tuple[int, tuple[np.ndarray, ...]]]) -> None:
        """From each block: keys, how many of its documents hold each now (0: none any more), and the largest of these."""
        if not told:
            return
        block = np.concatenate([np.full(len(x[0]), b, np.int64) for b, x in told])
        k1, k2, count, largest = (np.concatenate([x[k] for _, x in told]) for k in range(4))
        known = self.filter.has(both(k1, k2))
        asked = np.unique(both(k1[known], k2[known]))
        # The rows of keys that may be there are looked up; a block's new word on a key replaces its old one.
        code = both(self.k1, self.k2)
        old = np.isin(code, asked)
        rows = [np.concatenate([x[old], y]) for x, y in ((self.k1, k1), (self.k2, k2), (self.block, block), (self.count, count), (self.largest, largest))]
        time = np.repeat([0, 1], [int(old.sum()), len(k1)])
        order = np.lexsort((time, rows[2], rows[1], rows[0]))
        rows = [x[order] for x in rows]
        last = np.append(firsts((rows[0], rows[1], rows[2]))[1:], True) if len(order) else np.zeros(0, bool)
        rows = [x[last & (rows[3] > 0)] for x in rows]
        before, after = np.unique(code[old]), np.unique(both(rows[0], rows[1]))
        self.filter.remove(np.setdiff1d(before, after))
        merged = [np.concatenate([x[~old], y]) for x, y in zip((self.k1, self.k2, self.block, self.count, self.largest), rows, strict=True)]
        order = np.lexsort((merged[2], merged[1], merged[0]))
        self.k1, self.k2, self.block, self.count, self.largest = (x[order] for x in merged)
        new, size = np.setdiff1d(after, before), int(firsts((self.k1, self.k2)).sum())
        if size > self.filter.capacity:  # grown: a filter of twice the size from the table's keys
            self.filter = CuckooFilter(2 * size)
            new = np.unique(both(self.k1, self.k2))
        self.filter.add(new)

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per key: its first row, number of rows, documents that hold it, the largest of them."""
        cut = np.flatnonzero(firsts((self.k1, self.k2)))
        size = np.diff(np.append(cut, len(self.k1)))
        return cut, size, np.add.reduceat(self.count, cut) if len(cut) else self.count, np.maximum.reduceat(self.largest, cut) if len(cut) else self.largest

    def answers(self, least_docs: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        """To each block: its keys that stand in ``least_docs`` documents or more, and the largest of these."""
        _, size, total, largest = self.totals()
        say = np.repeat(total >= least_docs, size)
        rows = self.k1[say], self.k2[say], np.repeat(largest, size)[say]
        for to, i in deal(self.block[say], 0):
            yield to, [x[i] for x in rows]

    def owners(self, k1: np.ndarray, k2: np.ndarray, least_docs: int) -> np.ndarray:
        """Which of these keys stand in ``least_docs`` documents or more, and in which largest one: (place, doc_id)."""
        ask = np.flatnonzero(self.filter.has(both(k1, k2)))
        cut, _, total, largest = self.totals()
        often = total >= least_docs
        where = {key: m for key, m in zip(zip(self.k1[cut[often]].tolist(), self.k2[cut[often]].tolist(), strict=True), largest[often].tolist(), strict=True)}
        hit = [(i, where[key]) for i, key in zip(ask.tolist(), zip(k1[ask].tolist(), k2[ask].tolist(), strict=True), strict=True) if key in where]
        return np.array(hit, np.int64).reshape(-1, 2)


def _letters(k1: np.ndarray, *columns: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    return [(to, pack(k1[i], *(x[i] for x in columns))) for to, i in deal(shard_of(k1, n), n)]


def _kept(block: Block, told: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least_chars: int) -> pa.Table:
    """The documents without the lines that belong to another one: ``told`` has key and owner."""
    owner: dict[bytes, int] = {}
    for k1, k2, largest in told:
        raw = np.stack([k1, k2], 1).tobytes()
        owner |= {raw[16 * i : 16 * i + 16]: m for i, m in enumerate(largest.tolist())}
    total, dropped, kept = [], [], []
    for i, doc in enumerate(block.ids.tolist()):
        lines = block.text(i).split(b"\n")
        stay = [x for x in lines if (k := line_key(x, least_chars)) is None or owner.get(xxhash.xxh3_128_digest(k), doc) == doc] if owner else lines
        total.append(len(lines))
        dropped.append(len(lines) - len(stay))
        kept.append(b"\n".join(stay))
    return pa.table([block.id_column(), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, carry: Column | None = None, net_: Net | None = None) -> DataFrame:
    """Drop the lines whose key stands in ``least_docs`` documents or more, but for the largest doc_id.

    All documents are put into the shards of an empty index (``Shard``), which then answer.  Lines are
    cut at each \\n (a null or empty text is one empty line); the key is the line
    stripped of white space with A-Z in lower case.  Keys under ``least_chars`` code points
    are never dropped.  The largest document that holds a key keeps all its lines of it.

    Returns doc_id, n_lines (before dropping), n_dropped, and the kept lines joined by \\n.
    Documents are told apart by doc_id: rows with one doc_id are one document when counting,
    and all of them keep what the largest document keeps; a null doc_id is smaller than any
    other.  Other columns are not looked at, but ``carry`` is returned with its row.  An empty
    table gives an empty result.
    """
    to_all = net_ or net(docs)
    dealt, carried = blocks(docs, to_all, carry), carry is not None

    def ask(table: pa.Table) -> pa.Table:
        k1, k2, count, largest = counted(*references(docs_of(table), least_chars))
        return to_all.post(to_all.me(table), _letters(k1, k2, count, largest, n=to_all.n))

    def judge(table: pa.Table) -> pa.Table:
        shard = Shard()
        shard.apply([(src, tuple(unpack(raw))) for src, raw in mail(table)])
        return to_all.post(to_all.me(table) if table.num_rows else 0, [(to, pack(*x)) for to, x in shard.answers(least_docs)])

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        block = docs_of(left)
        got = _kept(block, [tuple(unpack(raw)) for _, raw in mail(right)], least_chars)
        return block.with_carry(got) if carried else got

    asked = to_all.exchange(dealt.groupBy("key").applyInArrow(ask, PACKED))
    told = to_all.exchange(asked.groupBy("key").applyInArrow(judge, PACKED))
    return few(dealt.groupBy("key").cogroup(told.groupBy("key")).applyInArrow(close, carrying(docs, SCHEMA, carry)), docs)


@dataclass(frozen=True)
class LineIndex:
    """A line index that documents can be put into and taken out of again.

    Its state is written: for each block its exact references (key, doc_id), for each shard its filter
    and reference counts (``Shard``).  An update reads and writes the blocks of its documents and the
    shards of their lines, no others: it adds their rows with the number of the update, and
    the newest row of each counts.  ``compact`` writes the newest rows anew.

    A doc_id that is there already gets new lines besides.  Deleting a doc_id takes out all that was
    put in under it; unknown ones are ignored.  A null doc_id is a document like others.
    """

    net: Net
    least_chars: int
    blocks: DataFrame
    shards: DataFrame
    updates: int = 0

    @classmethod
    def empty(cls, docs: DataFrame, least_chars: int = 20) -> LineIndex:
        """An index with blocks and shards for a corpus of the size of ``docs``; it may hold more."""
        none = docs.sparkSession.createDataFrame([], PACKED)
        return cls(net(docs), least_chars, none, none)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        """Of each key the row with the largest src; only keys and numbers are compared."""
        return rows.join(F.broadcast(rows.groupBy("key").agg(F.max("src").alias("src"))), ["key", "src"], "left_semi").select("key", "src", "payload")

    def _touched(self, rows: DataFrame, by: DataFrame) -> DataFrame:
        """The newest rows of the keys in ``by``, of which there is at most one for each block."""
        return self._newest(rows).join(F.broadcast(by.select("key").distinct()), "key", "left_semi").repartition(self.net.n, "key")

    def _update(self, dealt: DataFrame, add: bool) -> LineIndex:
        to_all, number, least = self.net, self.updates + 1, self.least_chars

        def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
            have = [unpack(p) for p in payloads(right)]
            old = tuple(have[0]) if have else (np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))
            block = docs_of(left)
            if add:
                new = tuple(np.concatenate(x) for x in zip(old, references(block, least), strict=True))
            else:
                stay = ~np.isin(old[2], block.ids)
                new = tuple(x[stay] for x in old)
            order = np.lexsort((new[2], new[1], new[0]))
            new = tuple(x[order][firsts(tuple(y[order] for y in new))] if len(order) else x for x in new)
            was, now = counted(*old), counted(*new)
            # Keys whose count or largest document has changed; gone ones have none.
            rows = [np.concatenate([x, y]) for x, y in zip((*was[:2], np.zeros(len(was[0]), np.int64), was[3]), now, strict=True)]
            order = np.lexsort((np.repeat([0, 1], [len(was[0]), len(now[0])]), rows[1], rows[0]))
            rows = [x[order] for x in rows]
            last = np.append(firsts((rows[0], rows[1]))[1:], True) if len(order) else np.zeros(0, bool)
            same = set(zip(*(x.tolist() for x in was), strict=True))
            rows = [x[last] for x in rows]
            differs = np.array([r not in same for r in zip(*(x.tolist() for x in rows), strict=True)], bool)
            k1, k2, count, largest = (x[differs] for x in rows)
            return to_all.post(to_all.me(left), _letters(k1, k2, count, largest, n=to_all.n), [(-1 - number, pack(*new))])

        def of_shard(left: pa.Table, right: pa.Table) -> pa.Table:
            shard = Shard(payloads(right)[0] if right.num_rows else None)
            shard.apply([(src, tuple(unpack(raw))) for src, raw in mail(left)])
            return to_all.post(to_all.me(left), [], [(number, shard.packed())])

        touched = self._touched(self.blocks, dealt)
        got = written(dealt.groupBy("key").cogroup(touched.groupBy("key")).applyInArrow(of_block, PACKED))
        mine = got.where(F.col("src") == -1 - number).select("key", F.lit(number).cast("long").alias("src"), "payload")
        letters = to_all.exchange(got.where(F.col("src") != -1 - number))
        shards = written(letters.groupBy("key").cogroup(self._touched(self.shards, letters).groupBy("key")).applyInArrow(of_shard, PACKED))
        return LineIndex(to_all, least, self.blocks.unionByName(mine), self.shards.unionByName(shards), number)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With these documents."""
        return self._update(blocks(docs, self.net), True)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of these doc_ids."""
        return self._update(blocks(ids.select("doc_id", F.lit(None).cast("string").alias("text")), self.net), False)

    def compact(self) -> LineIndex:
        """The same index in one row for each block and shard."""
        return LineIndex(self.net, self.least_chars, written(self._newest(self.blocks)), written(self._newest(self.shards)), self.updates)

    def drop(self, docs: DataFrame, least_docs: int = 3) -> DataFrame:
        """Documents without the lines that, by the index, stand in ``least_docs`` documents or more and belong to another.

        The result is that of ``drop_repeated_lines``; the index is read, not changed.
        """
        to_all, least = self.net, self.least_chars
        dealt = blocks(docs, to_all)

        def ask(table: pa.Table) -> pa.Table:
            k1, k2, _, _ = counted(*references(docs_of(table), least))
            return to_all.post(to_all.me(table), _letters(k1, k2, n=to_all.n))

        def judge(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return to_all.post(0, [])
            shard, out = Shard(payloads(right)[0]), []
            for src, raw in mail(left):
                k1, k2 = unpack(raw)
                hit = shard.owners(k1, k2, least_docs)
                out.append((src, pack(k1[hit[:, 0]], k2[hit[:, 0]], hit[:, 1].copy())))
            return to_all.post(to_all.me(left), out)

        asked = to_all.exchange(dealt.groupBy("key").applyInArrow(ask, PACKED))
        shards = self._newest(self.shards).repartition(to_all.n, "key")
        told = to_all.exchange(asked.groupBy("key").cogroup(shards.groupBy("key")).applyInArrow(judge, PACKED))
        close = lambda left, right: _kept(docs_of(left), [tuple(unpack(raw)) for _, raw in mail(right)], least)
        return dealt.groupBy("key").cogroup(told.groupBy("key")).applyInArrow(close, SCHEMA)

    def counts(self, least_docs: int = 3) -> DataFrame:
        """Keys in ``least_docs`` documents or more: hash, number of documents, largest doc_id."""

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    s = Shard(raw)
                    cut, _, total, largest = s.totals()
                    on = total >= least_docs
                    cols = [s.k1[cut[on]].view(np.int64), s.k2[cut[on]].view(np.int64), total[on], largest[on]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:3]), pa.array(cols[3], mask=cols[3] == NULL_ID)], names=["k1", "k2", "n_docs", "max_doc"])

        return self._newest(self.shards).select("payload").mapInArrow(judge, COUNTS)

    def filter_keys(self) -> int:
        """How many fingerprints all filters hold, for a look at the index."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = [int((s.filter.table > 0).sum()) + len(s.filter.spill) for s in map(Shard, batch.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

        return self._newest(self.shards).select("payload").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
