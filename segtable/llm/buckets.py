"""Which windows of the corpus occurred earlier: buckets of windows, and the text that travels to them.

A window is ``size`` consecutive symbols (bytes or words) of one document.  Consecutive
windows that share a minimiser form a *super-window*; equal windows have equal minimisers
at equal offsets, so only super-windows of one minimiser bucket can share windows.

1. Each block sends the hash of each distinct bucket, and how many different super-windows it
   has there, to the bucket's shard.  A bucket that one super-window is alone in needs no
   answer; one that lies in a single block is settled by that block.
2. The others' super-windows travel to the shard as packed strings, one for each distinct content
   of a block.  In buckets of more than ``SPREAD`` strings each window travels on its own,
   to a shard by its own hash, so that such a bucket spreads over all shards.  The shards compare
   symbols, never hashes: hashes only say where to look.  Answers are one bit per window.
3. Each block combines the answers with what it knows of its own documents.

Nothing is dropped or capped: each window is decided by one of these ways.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from . import kernels as K
from .base import PACKED, Block, Net, blocks, carrying, deal, docs_of, few, mail, mix, net, pack, unpack

_U = np.uint64
SPREAD = 4096
SHARED, WIDE = 1, 2
_Z = np.zeros(0, np.int64)

#: Gets packed strings, their places (document, first window), how many windows each has; says which windows an earlier string holds.
Refine = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Shape:
    """size: symbols in a window; gram: symbols in a minimiser; words: symbols are words, else bytes.

    ``same_doc``: earlier also means at a smaller place of the same document.
    """

    size: int
    gram: int
    words: bool
    same_doc: bool

    def __post_init__(self) -> None:
        if not 1 <= self.gram <= self.size:
            raise ValueError(f"a minimiser of {self.gram} symbols doesn't fit into a window of {self.size}")

    def symbols(self, block: Block, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of documents a to b: values, documents' offsets, byte starts and ends of each."""
        off = block.off[a : b + 1] - block.off[a]
        buf = block.buf[block.off[a] : block.off[b] + 8]
        if not self.words:
            return K.byte_symbols(buf[: off[-1]]), off, _Z, _Z
        starts, ends, first = K.words(buf, off)
        return K.word_hashes(buf, starts, ends), first, starts, ends

    def string(self, raw: bytes) -> bytes:
        """Words parted by one space each."""
        return b" ".join(raw.split()) if self.words else raw

    def windows(self, text: bytes, count: int) -> list[bytes]:
        """The windows of a packed string."""
        if not self.words:
            return [text[j : j + self.size] for j in range(count)]
        w = text.split(b" ")
        return [b" ".join(w[j : j + self.size]) for j in range(count)]

    def earlier(self, ids: np.ndarray, first: np.ndarray, head_id: np.ndarray, head_first: np.ndarray) -> np.ndarray:
        """Whether places come later than those of their heads."""
        later = ids > head_id
        return later | ((ids == head_id) & (first > head_first)) if self.same_doc else later


class Supers:
    """The super-windows of a block, and a *lead* for each distinct content: its first occurrence here."""

    def __init__(self, block: Block, shape: Shape, bits: int):
        self.block, self.shape = block, shape
        got: list[list[np.ndarray]] = [[] for _ in range(7)]
        for a, b in block.chunks(256 << 10):
            values, off, starts, ends = shape.symbols(block, a, b)
            doc, first, count, h, c = K.super_windows(off, shape.size, shape.gram, K.Rolling(values))
            last = first + count + shape.size - 2
            low, high = (starts[first], ends[last]) if shape.words else (first, last + 1)
            base = block.off[a]
            for to, x in zip(got, ((doc + a).astype(np.int32), first - off[doc], count.astype(np.int32), h, c, low + base, high + base), strict=True):
                to.append(x)
        self.doc, self.first, self.count, h, c, self.low, self.high = (np.concatenate(x) if x else _Z for x in got)
        h, c = h.astype(_U), c.astype(_U)
        self.id = block.ids[self.doc.astype(np.int64)] if len(self.doc) else _Z
        # Records are in order of (doc_id, first) but where one doc_id stands in several rows.
        rank = np.arange(len(h))
        if len(block.ids) > 1 and (block.ids[1:] == block.ids[:-1]).any():
            rank[np.lexsort((self.first, self.id))] = np.arange(len(rank))
        while True:
            order = ordered(h, c, rank)
            new = firsts((h[order], c[order]))
            heads = np.flatnonzero(new)
            lead = order[heads]
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            if not len(wrong := self._unlike(group, lead)):
                break
            c[wrong] = mix(c[wrong] + _U(1))  # other symbols with the same hashes: a content of their own
        self.lead, self.group = lead, group
        self.bucket = h[lead] >> _U(64 - bits)  # of leads, in ascending order

    def _unlike(self, group: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Which records' symbols are not their lead's."""
        at = np.flatnonzero(lead[group] != np.arange(len(group)))
        raw, head = self.block.bytes, lead[group[at]]
        same = [raw[a:b] == raw[c:d] or self.shape.words and raw[a:b].split() == raw[c:d].split() for a, b, c, d in zip(self.low[at].tolist(), self.high[at].tolist(), self.low[head].tolist(), self.high[head].tolist(), strict=True)]
        return at[~np.array(same, bool)] if len(at) else at

    def texts(self, leads: np.ndarray) -> list[bytes]:
        r = self.lead[leads]
        return [self.shape.string(self.block.bytes[a:b]) for a, b in zip(self.low[r].tolist(), self.high[r].tolist(), strict=True)]

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct buckets, and where the leads of each begin."""
        cut = np.flatnonzero(firsts((self.bucket,)))
        return self.bucket[cut], cut

    def wide(self, leads: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of these leads with their first (id, first) here; each window's number among them and place."""
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(w, len(seen)) for t, n in zip(self.texts(leads), self.count[self.lead[leads]].tolist(), strict=True) for w in self.shape.windows(t, n)], np.int64)
        count = self.count[self.lead[leads]].astype(np.int64)
        own = np.repeat(self.lead[leads], count)
        ids, place = self.id[own], self.first[own] + spans(np.zeros(len(count), np.int64), count)
        order = np.lexsort((place, ids, of))
        at = order[firsts((of[order],))]
        return list(seen), ids[at], place[at], of, ids, place


def ordered(h: np.ndarray, c: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order by h, c, then rank; only equal h are sorted on more than h."""
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    tied = np.zeros(len(h), bool)
    tied[1:] = same
    tied[:-1] |= same
    sub = order[tied]
    order[tied] = sub[np.lexsort((rank[sub], c[sub], h[sub]))]
    return order


def both(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(h + mix(c + _U(1)))


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + _U(0x5851F42D4C957F2D)) % _U(n)).astype(np.int64)


def firsts(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """For sorted columns: whether each row starts a new group."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0] .. stop[0]-1, start[1] .. stop[1]-1 and so on."""
    count = stop - start
    begin = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - begin, count)


def edges(covered: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which end at documents' ends."""
    begin, end = covered.copy(), covered.copy()
    if len(covered):
        begin[1:] &= ~covered[:-1]
        end[:-1] &= ~covered[1:]
        cut = off[(off > 0) & (off < off[-1])]
        begin[cut] = covered[cut]
        end[cut - 1] = covered[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def dense(values: np.ndarray) -> np.ndarray:
    """Equal values get equal numbers under 2**32, in sorted order."""
    order = np.argsort(values)
    s = values[order]
    number = np.zeros(len(s), _U)
    if len(s):
        np.cumsum(s[1:] != s[:-1], out=number[1:])
    out = np.empty_like(number)
    out[order] = number
    return out


def later_windows(win: np.ndarray, ids: np.ndarray, place: np.ndarray, shape: Shape) -> np.ndarray:
    """For windows with exact identities: whether an equal one has an earlier place."""
    order = np.lexsort((place, ids, win))
    w, d, p = win[order], ids[order], place[order]
    new = firsts((w,))
    head = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    out = np.zeros(len(w), bool)
    out[order] = shape.earlier(d, p, d[head], p[head])
    return out


def judged(texts: list[bytes], bucket: np.ndarray, ids: np.ndarray, first: np.ndarray, count: np.ndarray, shape: Shape, refine: Refine, chunk: int = 1 << 20) -> np.ndarray:
    """For packed strings: for each window, one string after another, whether it occurred earlier in one of them.

    Equal strings are found by comparing them; of each content the earliest stands for it, and
    in buckets with several contents those are refined, whole buckets of about ``chunk`` bytes at a time.
    """
    m = len(texts)
    count = count.astype(np.int64)
    known: dict[bytes, int] = {}
    content = np.array([known.setdefault(t, len(known)) for t in texts], np.int64)
    order = np.lexsort((first, ids, content))
    new = firsts((content[order],))
    head = np.empty(m, np.int64)
    head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if m else order
    whole = shape.earlier(ids, first, ids[head], first[head])
    at = np.concatenate([[0], np.cumsum(count)])
    hit = np.zeros(int(at[-1]), bool)
    lead = order[new]
    lead = lead[np.argsort(bucket[lead], kind="stable")]
    cut = K.runs(bucket[lead])
    size = np.array([len(texts[i]) for i in lead], np.int64)
    several = np.flatnonzero(np.diff(cut) > 1)
    total = np.cumsum([int(size[cut[g] : cut[g + 1]].sum()) for g in several])
    a = 0
    while a < len(several):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + chunk, "right")))
        some = lead[spans(cut[several[a:b]], cut[several[a:b] + 1])]
        hit[spans(at[some], at[some] + count[some])] = refine([texts[i] for i in some.tolist()], ids[some], first[some], count[some])
        a = b
    follow = np.flatnonzero(head != np.arange(m))
    hit[spans(at[follow], at[follow] + count[follow])] = hit[spans(at[head[follow]], at[head[follow]] + count[follow])]
    hit[spans(at[:-1][whole], at[1:][whole])] = True
    return hit


def pack_strings(texts: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.array([len(t) for t in texts], np.int64), b"".join(texts)


def split_strings(size: np.ndarray, raw: bytes) -> list[bytes]:
    at = np.concatenate([[0], np.cumsum(size)]).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def by_kind(table: pa.Table, kind: int) -> list[tuple[int, list]]:
    """Unpacked letters of one kind: sender, columns."""
    out = []
    for src, raw in mail(table):
        got = unpack(raw)
        if int(got[0][0]) == kind:
            out.append((src, got[1:]))
    return out


#: ``finish`` gets a block and, chunk by chunk, (a, b, offsets in symbols, covered, (starts, ends)) for its documents a to b.
Finish = Callable[[Block, Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]], pa.Table]


def mark(docs: DataFrame, shape: Shape, refine: Refine, finish: Finish, schema: str, carry: Column | None = None, spread: int = SPREAD, net_: Net | None = None) -> DataFrame:
    """``finish`` of each block, told which symbols a window covers that occurred earlier.

    Earlier means in a smaller doc_id and, by ``shape``, also at a smaller place of the
    same document.  ``carry`` is returned with each row.
    """
    to_all = net_ or net(docs)
    n = to_all.n
    # So many bits that few buckets meet by chance; if they do, their strings are compared for nothing.
    bits = min(64, max(32, int(to_all.size).bit_length() + 8))
    dealt, carried = blocks(docs, to_all, carry), carry is not None

    def asks(s: Supers) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """Buckets, where their leads begin, how many leads, and to which shards they go, in order."""
        value, cut = s.buckets()
        return value, cut, np.diff(np.append(cut, len(s.lead))), list(deal(shard_of(value, n), n))

    def ask(table: pa.Table) -> pa.Table:
        value, _, size, to = asks(Supers(docs_of(table), shape, bits))
        return to_all.post(to_all.me(table), [(k, pack(np.int8([0]), np.diff(value[i], prepend=_U(0)), size[i].astype(np.int32))) for k, i in to])

    def judge(table: pa.Table) -> pa.Table:
        got = by_kind(table, 0)
        if not got:
            return to_all.post(0, [])
        value = np.concatenate([np.cumsum(g[0], dtype=_U) for _, g in got])
        size = np.concatenate([g[1] for _, g in got]).astype(np.int64)
        order = np.argsort(value, kind="stable")
        cut = np.flatnonzero(firsts((value[order],)))
        blocks_of = np.diff(np.append(cut, len(order)))
        total = np.add.reduceat(size[order], cut)
        code = np.empty(len(order), np.int8)
        code[order] = np.repeat(np.where(blocks_of < 2, 0, np.where(total > spread, WIDE, SHARED)), blocks_of)
        at = np.cumsum([0, *(len(g[0]) for _, g in got)])
        me = to_all.me(table)
        return to_all.post(me, [(src, pack(np.int8([0]), code[a:b])) for (src, _), a, b in zip(got, at[:-1], at[1:], strict=True)])

    def codes(s: Supers, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """For each lead the shards' verdict on its bucket, and how many leads its bucket has here."""
        _, _, size, to = asks(s)
        code, told = np.zeros(len(size), np.int8), dict(by_kind(table, 0))
        for k, i in to:
            code[i] = told[k][0]
        return np.repeat(code, size), np.repeat(size, size)

    def parcels(s: Supers, code: np.ndarray):
        """What goes to which shards: leads of shared buckets, and distinct windows of wide ones."""
        shared, wide = np.flatnonzero(code == SHARED), np.flatnonzero(code == WIDE)
        texts, ids, first, of, own_id, own_first = s.wide(wide)
        h = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], _U)
        return shared, [(k, shared[i]) for k, i in deal(shard_of(s.bucket[shared], n), n)], wide, texts, ids, first, of, own_id, own_first, list(deal(shard_of(h, n), n))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_all.post(0, [])
        s = Supers(docs_of(left), shape, bits)
        _, to, _, texts, ids, first, _, _, _, wide_to = parcels(s, codes(s, right)[0])
        out = []
        for k, i in to:
            r = s.lead[i]
            out.append((k, pack(np.int8([1]), np.diff(s.bucket[i], prepend=_U(0)), s.id[r], s.first[r], s.count[r], *pack_strings(s.texts(i)))))
        out += [(k, pack(np.int8([2]), ids[i], first[i], *pack_strings([texts[j] for j in i.tolist()]))) for k, i in wide_to]
        return to_all.post(to_all.me(left), out)

    def settle(table: pa.Table) -> pa.Table:
        out = []
        if got := by_kind(table, 1):
            bucket = np.concatenate([np.cumsum(g[0], dtype=_U) for _, g in got])
            ids, first, count = (np.concatenate([g[k] for _, g in got]) for k in (1, 2, 3))
            texts = [t for _, g in got for t in split_strings(g[4], g[5])]
            hit = judged(texts, bucket, ids, first, count, shape, refine)
            at = np.cumsum([0, *(int(g[3].sum()) for _, g in got)])
            out += [(src, pack(np.int8([1]), np.packbits(hit[a:b]))) for (src, _), a, b in zip(got, at[:-1], at[1:], strict=True)]
        if got := by_kind(table, 2):
            ids, first = (np.concatenate([g[k] for _, g in got]) for k in (0, 1))
            seen: dict[bytes, int] = {}
            win = np.array([seen.setdefault(t, len(seen)) for _, g in got for t in split_strings(g[2], g[3])], np.int64)
            hit = later_windows(win, ids, first, shape)
            at = np.cumsum([0, *(len(g[0]) for _, g in got)])
            out += [(src, pack(np.int8([2]), np.packbits(hit[a:b]))) for (src, _), a, b in zip(got, at[:-1], at[1:], strict=True)]
        return to_all.post(to_all.me(table), out)

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        block = docs_of(left)
        s = Supers(block, shape, bits)
        count = s.count[s.lead].astype(np.int64)
        at = np.concatenate([[0], np.cumsum(count)])
        hit = np.zeros(int(at[-1]), bool)
        if len(s.lead):
            code, here = codes(s, right)
            _, to, wide, _, ids, first, of, own_id, own_first, wide_to = parcels(s, code)
            told = dict(by_kind(right, 1))
            for k, i in to:
                where = spans(at[i], at[i + 1])
                hit[where] = np.unpackbits(told[k][0], count=len(where)).astype(bool)
            if len(wide):
                told = dict(by_kind(right, 2))
                elsewhere = np.zeros(len(ids), bool)
                for k, i in wide_to:
                    elsewhere[i] = np.unpackbits(told[k][0], count=len(i)).astype(bool)
                hit[spans(at[wide], at[wide + 1])] = elsewhere[of] | shape.earlier(own_id, own_first, ids[of], first[of])
            mine = np.flatnonzero((code == 0) & (here > 1))
            if len(mine):
                r = s.lead[mine]
                hit[spans(at[mine], at[mine + 1])] = judged(s.texts(mine), s.bucket[mine], s.id[r], s.first[r], s.count[r], shape, refine)
        lead = s.lead[s.group]
        whole = shape.earlier(s.id, s.first, s.id[lead], s.first[lead])
        some = np.logical_or.reduceat(hit, at[:-1]) if len(s.lead) else np.zeros(0, bool)

        def covered() -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
            for a, b in block.chunks(1 << 20):
                off = block.off[a : b + 1] - block.off[a]
                places: tuple = ()
                if shape.words:
                    starts, ends, off = K.words(block.buf[block.off[a] : block.off[b] + 8], off)
                    places = (starts, ends)
                lo, hi = np.searchsorted(s.doc, (a, b))
                step = np.zeros(off[-1] + 1, np.int32)
                full = np.flatnonzero(whole[lo:hi]) + lo
                begin = s.first[full] + off[s.doc[full] - a]
                np.add.at(step, begin, 1)
                np.add.at(step, begin + s.count[full] + shape.size - 1, -1)
                part = np.flatnonzero(~whole[lo:hi] & some[s.group[lo:hi]]) + lo
                g = s.group[part]
                on = hit[spans(at[g], at[g + 1])]
                begin = s.first[part] + off[s.doc[part] - a]
                begin = spans(begin, begin + count[g])[on]
                np.add.at(step, begin, 1)
                np.add.at(step, begin + shape.size, -1)
                yield a, b, off, np.cumsum(step[:-1]) > 0, places

        got = finish(block, covered())
        return block.with_carry(got) if carried else got

    asked = to_all.exchange(dealt.groupBy("key").applyInArrow(ask, PACKED))
    told = to_all.exchange(asked.groupBy("key").applyInArrow(judge, PACKED))
    sent = to_all.exchange(dealt.groupBy("key").cogroup(told.groupBy("key")).applyInArrow(send, PACKED))
    answers = told.union(to_all.exchange(sent.groupBy("key").applyInArrow(settle, PACKED)))
    return few(dealt.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(close, carrying(docs, schema, carry)), docs)
