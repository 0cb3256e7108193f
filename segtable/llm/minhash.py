"""Near-duplicate classes by ProbMinHash over weighted word shingles.

The similarity is the probability Jaccard index J_P of the documents' shingle counts, which
doesn't change when a document is repeated as a whole, and is the Jaccard index if all counts
are one.  Each shingle sends a Poisson process of arrivals, at the rate of its count, to the
registers of its document; a register keeps the shingle that arrives first, and two documents
agree in a register with probability J_P.  Generation ends as soon as no later arrival can
change a register.

Registers form bands.  In each band's bucket two documents lead, those of least and of largest
hash of (doc_id, band modulo 4), so leaders differ, but are few for a group of copies; every other document of the bucket is
verified against both with the exact J_P of whole shingle counts.  That is linear in a bucket's
size, and joins most of what belongs together.

The rest is settled exactly.  Each block tells a bucket's shard the least and largest component of its
members that don't lead; where these are not all in one component yet, they are compared with each other, in tiles of ``TILE`` by ``TILE`` documents that
spread over all shards.  Products of count and presence matrices bound J_P from above; pairs of
different components that pass the bound are verified.  Classes are the connected components
of all verified links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .base import PACKED, Block, Net, block_of, blocks, deal, docs_of, few, id_column, mail, mix, net, pack, payloads, release, unpack, written
from .buckets import firsts, shard_of
from .components import STATE, components, label_of, state_row

_U = np.uint64
SCHEMA = "doc_id long, class_id long"
_HASH_BITS = 48
IDS, OPEN, TEXTS, MINE = -2, -3, -5, -6  # in column src, like STATE: a block's doc_ids, its members that don't lead, these members' texts, what it keeps
EDGES = -4  # the first number of a letter with links
TILE = 512
SALTS = 4  # of so many orders each band has one; a group of copies has up to twice as many leaders, whose texts travel


def shingle_counts(block: Block, a: int, b: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of documents a to b: document (from 0), 48-bit hash, count; in this order.

    A text of fewer than ``size`` words has one shingle of all its words.
    """
    off = block.off[a : b + 1] - block.off[a]
    buf = block.buf[block.off[a] : block.off[b] + 8]
    starts, ends, first = K.words(buf, off)
    roll = K.Rolling(K.word_hashes(buf, starts, ends))
    n = np.diff(first)
    room = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    doc = np.repeat(np.arange(b - a), room)
    at = np.arange(len(doc)) + np.repeat(first[:-1] - (np.cumsum(room) - room), room)
    h = roll.of(at, np.minimum(at + size, first[1:][doc])) >> _U(64 - _HASH_BITS)
    out = []
    for lo in range(0, b - a, 1 << 15):  # the document's number takes the upper bits
        i, j = np.searchsorted(doc, (lo, lo + (1 << 15)))
        key = np.sort((doc[i:j] - lo).astype(_U) << _U(_HASH_BITS) | h[i:j])
        cut = K.runs(key)
        out.append(((key[cut[:-1]] >> _U(_HASH_BITS)).astype(np.int64) + lo, key[cut[:-1]] & _U((1 << _HASH_BITS) - 1), np.diff(cut)) if len(key) else (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))


def prob_minhash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Signatures: for each document and register the shingle that arrives first (0: none arrives).

    The arrivals of a shingle are a Poisson process of its count; each goes to a register at
    random.  They are made in rounds of 1, 1, 2, 4 ... for all shingles at once; a shingle drops
    out when its next arrival comes later than the last of its document's registers.
    """
    time = np.full(docs * registers, np.inf)
    who = np.zeros(docs * registers, _U)
    clock = np.zeros(len(h))
    live = np.arange(len(h))
    made, step = 0, 1
    while len(live):
        for a in range(0, len(live), max(1, (1 << 19) // step)):
            some = live[a : a + max(1, (1 << 19) // step)]
            r = mix(h[some][:, None] * _U(0x9E3779B97F4A7C15) + (np.arange(made + 1, made + step + 1, dtype=_U) * _U(0xD1B54A32D192ED03))[None, :])
            gap = -np.log1p(-(r >> _U(11)).astype(np.float64) * 2.0**-53) / count[some][:, None]
            t = clock[some][:, None] + np.cumsum(gap, 1)
            reg = ((mix(r) >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64) + doc[some][:, None] * registers
            clock[some] = t[:, -1]
            t, reg, at = t.ravel(), reg.ravel(), np.repeat(some, step)
            on = np.flatnonzero(t < time[reg])
            t, reg, at = t[on], reg[on], at[on]
            np.minimum.at(time, reg, t)
            won = t == time[reg]
            who[reg[won]] = h[at[won]] + _U(1)
        made += step
        step = min(made, 64)
        live = live[clock[live] < time.reshape(docs, registers).max(1)[doc[live]]]
    return who.reshape(docs, registers)


def prob_jaccard(h1: np.ndarray, c1: np.ndarray, h2: np.ndarray, c2: np.ndarray) -> float:
    """J_P of two documents: the sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    both, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = c1[i].astype(np.float64), c2[j].astype(np.float64)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    last = np.searchsorted(ratio, ratio, "right")
    # Where y_j / x_j is no larger than y_i / x_i, x decides, else y; what is in one only is at the ends.
    upto = np.concatenate([[0], np.cumsum(x)])[last] + (c1.sum() - x.sum())
    after = y.sum() - np.concatenate([[0], np.cumsum(y)])[last] + (c2.sum() - y.sum())
    return float((1 / (upto / x + after / y)).sum())


def _texts(block: Block, rows_: np.ndarray) -> bytes:
    """Some rows of a block, to be read by ``Block``."""
    return pack(block.ids[rows_], np.diff(block.off)[rows_].astype(np.uint32), b"".join(map(block.text, rows_.tolist())))


def _rows_of(ids: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the asked ids in ordered ids, and of each which of the asked it is."""
    lo, hi = np.searchsorted(ids, asked), np.searchsorted(ids, asked, "right")
    of = np.repeat(np.arange(len(asked)), hi - lo)
    return np.arange(len(of)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo), of


def _features(block: Block, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles and counts of each document."""
    out = []
    for a, b in block.chunks(1 << 20):
        doc, h, c = shingle_counts(block, a, b, size)
        cut = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
        out += [(h[x:y], c[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return out


def upper_bounds(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 22) -> np.ndarray:
    """For each pair a number that J_P doesn't exceed, and that is J_P if all counts are one.

    With x and y the sums of counts, and x' and y' those of common shingles, J_P is at most
    x'y' / (x y' + (y - y') x') and at most x'y' / ((x - x') y' + y x'): the terms of its sum are, with fewer
    maxima, concave and homogeneous in (x_i, y_i), so their sum is no more than the term of the sums.
    """
    all_ = left + right
    n, m = len(left), len(all_)
    doc = np.repeat(np.arange(m), [len(h) for h, _ in all_])
    count = np.concatenate([c for _, c in all_]).astype(np.float64)
    _, col, often = np.unique(np.concatenate([h for h, _ in all_]), return_inverse=True, return_counts=True)
    total = np.bincount(doc, count, m)
    # What one document has alone is in no product.
    on = np.flatnonzero(often[col] > 1)
    on = on[np.argsort(col[on], kind="stable")]
    doc, count = doc[on], count[on]
    col = np.cumsum(firsts((col[on],))) - 1
    kind = np.float32 if total.max(initial=0) < 1 << 24 else np.float64  # sums are exact
    x, y = np.zeros((n, m - n)), np.zeros((n, m - n))
    wide = max(1, cells // m)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        i, j = np.searchsorted(col, (a, a + wide))
        has, times = np.zeros((m, wide), kind), np.zeros((m, wide), kind)
        has[doc[i:j], col[i:j] - a] = 1
        times[doc[i:j], col[i:j] - a] = count[i:j]
        x += times[:n] @ has[n:].T
        y += has[:n] @ times[n:].T
    sx, sy = total[:n, None], total[None, n:]
    under = np.maximum(sx * y + (sy - y) * x, (sx - x) * y + sy * x)
    return np.divide(x * y, under, out=np.zeros_like(x), where=under > 0)


def settle(left: list, right: list | None, ids: list[np.ndarray], labels: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all components (labels) with a pair of ``threshold`` or more between left and right.

    Without ``right`` left is compared with itself.
    """
    other = left if right is None else right
    bound = upper_bounds(left, other)
    i, j = np.nonzero((bound >= threshold - 1e-9) & (labels[0][:, None] != labels[-1][None, :]))
    if right is None:
        i, j = i[i < j], j[i < j]
    order = np.argsort(-bound[i, j], kind="stable")
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    a, b = [], []
    for i_, j_ in zip(i[order].tolist(), j[order].tolist(), strict=True):
        x, y = find(int(labels[0][i_])), find(int(labels[-1][j_]))
        if x != y and prob_jaccard(*left[i_], *other[j_]) >= threshold - 1e-12:
            root[max(x, y)] = min(x, y)
            a.append(ids[0][i_])
            b.append(ids[-1][j_])
    return np.array(a, np.int64), np.array(b, np.int64)


def near_classes(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 21, rows: int = 6, net_: Net | None = None) -> DataFrame:
    """The near-duplicate class of each document: the least doc_id that it is linked to.

    Documents are linked if their shingles of ``size`` words have J_P of ``threshold`` or more
    and ``bands`` of ``rows`` registers make them meet: of pairs at 0.8 all but about 1 in 500, at
    0.9 all but 1 in 10**7.  However crowded a bucket is, no pair that meets there is left out.  Words are what white space parts, unchanged.  Texts with equal
    shingle counts are equal here and take part once per block.

    A null or wordless text is like no other and a class of its own.  Rows with one doc_id are
    one document, so in one class, and each gets a row; a null doc_id is such a document too,
    and smaller than any other.  Other columns are not looked at.  An empty table gives none.
    """
    to_all = net_ or net(docs)
    n, me_of, post = to_all.n, to_all.me, to_all.post
    registers = bands * rows
    dealt = blocks(docs, to_all)

    def ask(table: pa.Table) -> pa.Table:
        block, me = docs_of(table), me_of(table)
        print_, marks, some = [], [], []
        for a, b in block.chunks(1 << 20):
            doc, h, c = shingle_counts(block, a, b, size)
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            p = np.zeros(b - a, _U)
            np.add.at(p, doc, mix(h * _U(2 * 0x51ED270B + 1) + c.astype(_U)))
            print_.append(mix(p))
            some.append(np.diff(cut) > 0)
            # Of texts with equal counts in this chunk only the first needs a signature.
            lead = np.unique(p, return_index=True)[1]
            lead = np.sort(lead[some[-1][lead]])
            new = np.full(b - a, -1)
            new[lead] = np.arange(len(lead))
            on = new[doc] >= 0
            sig = prob_minhash(new[doc[on]], h[on], c[on], len(lead), registers).reshape(len(lead), bands, rows)
            key = np.zeros((len(lead), bands), _U)
            for k in range(rows):
                key = mix(key * _U(0x9E3779B97F4A7C15) + sig[:, :, k] + _U(k + 1))
            key = mix(key + np.arange(1, bands + 1, dtype=_U)[None, :] * _U(0xA24BAED4963EE407))
            marks.append((a + lead, key))
        row = np.concatenate([m[0] for m in marks]) if marks else np.zeros(0, np.int64)
        key = np.concatenate([m[1] for m in marks]) if marks else np.zeros((0, bands), _U)
        prints = np.concatenate(print_) if print_ else np.zeros(0, _U)
        has = np.concatenate(some) if some else np.zeros(0, bool)
        # The first row of equal ones stands for them; wordless texts stand alone.
        rep = np.arange(len(block))
        at = np.flatnonzero(has)
        _, first, back = np.unique(prints[at], return_index=True, return_inverse=True)
        rep[at] = at[first[back]]
        on = rep[row] == row
        row, key = row[on], key[on]
        return post(me, _bucket_rows(key, block.ids[row], n, bands), [(MINE, pack(block.ids, rep, row, key.ravel(), prints[row]))])

    def judge(table: pa.Table) -> pa.Table:
        src, key, low, high, band, here = [], [], [], [], [], []
        for s, raw in mail(table):
            if s != MINE:
                got = unpack(raw)
                src.append(np.full(len(got[0]), s))
                for to, x in zip((key, low, high, band, here), got, strict=True):
                    to.append(x)
        if not src:
            return post(0, [])
        src, key, low, high, band, here = (np.concatenate(x) for x in (src, key, low, high, band, here))
        order = np.argsort(key, kind="stable")
        src, key, low, high, band, here = (x[order] for x in (src, key, low, high, band, here))
        cut = np.flatnonzero(firsts((key,)))
        # The band salts the ids, so that leaders differ from band to band.
        p_low, p_high = _salted(low, band), _salted(high, band)
        count = np.diff(np.append(cut, len(key)))
        lead = _pick(p_low, low, cut, count, np.minimum)
        last = _pick(p_high, high, cut, count, np.maximum)
        all_ = np.repeat(np.add.reduceat(here, cut), count)
        say = all_ > 1
        answer = key[say], np.repeat(lead, count)[say], np.repeat(last, count)[say], (all_[say] > 3).astype(np.int8)
        return post(me_of(table), [(to, pack(*(x[i] for x in answer))) for to, i in deal(src[say], n)])

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = next((unpack(raw) for src, raw in mail(left) if src == MINE), None)
        if mine is None:
            return post(0, [])
        me = me_of(left)
        ids, rep, row, key, prints = mine
        a = b = np.zeros(0, np.int64)
        rest: tuple[np.ndarray, ...] = (np.zeros(0, _U), a, np.zeros(0, _U))
        if right.num_rows:
            k, l1, l2, more = (np.concatenate(x) for x in zip(*(unpack(raw) for _, raw in mail(right)), strict=True))
            order = np.argsort(k)
            k, l1, l2, more = k[order], l1[order], l2[order], more[order]
            at = np.minimum(np.searchsorted(k, key), len(k) - 1)
            hit = np.flatnonzero(k[at] == key)
            member, at = row[hit // bands], at[hit]
            own, lead, last = ids[member], l1[at], l2[at]
            # A pair of leaders is verified once, where the second is.
            on = own != lead
            a = np.concatenate([member[on], member[on & (own != last)]])
            b = np.concatenate([lead[on], last[on & (own != last)]])
            on &= (own != last) & (more[at] > 0)  # there are others that don't lead
            rest = key[hit[on]], own[on], prints[hit[on] // bands]
            pair = np.unique(np.stack([a, b], 1), axis=0)
            a, b = pair[:, 0].copy(), pair[:, 1].copy()
        asked = np.unique(b)
        return post(me, [(to, pack(asked[i])) for to, i in deal(block_of(asked, n), n)], [(MINE, pack(ids, rep, a, b, *rest))])

    def serve(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = [(src, unpack(raw)[0]) for src, raw in mail(right) if src != MINE]
        if not asked or not left.num_rows:
            return post(0, [])
        block = docs_of(left)
        return post(me_of(left), [(src, _texts(block, _rows_of(block.ids, ids)[0])) for src, ids in asked])

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return post(0, [])
        got = list(mail(right))
        ids, rep, a, b, *rest = next(unpack(raw) for src, raw in got if src == MINE)
        block, me = docs_of(left), me_of(left)
        other = Block([raw for src, raw in got if src != MINE])
        theirs = _features(other, size)
        good = np.zeros(len(a), bool)
        last, mine = -1, None
        lo, hi = np.searchsorted(other.ids, b).tolist(), np.searchsorted(other.ids, b, "right").tolist()
        for k, i in enumerate(a.tolist()):
            if i != last:
                _, h, c = shingle_counts(block, i, i + 1, size)
                last, mine = i, (h, c)
            good[k] = any(prob_jaccard(*mine, *x) >= threshold - 1e-12 for x in theirs[lo[k] : hi[k]])
        # Copies hang on the row that stands for them.
        copy = np.flatnonzero(ids != ids[rep])
        x = np.concatenate([ids[a[good]], ids[copy]])
        y = np.concatenate([b[good], ids[rep[copy]]])
        return post(me, [], [state_row(me, x, y), (IDS, pack(ids)), (OPEN, pack(*rest)), (TEXTS, _texts(block, _rows_of(block.ids, np.unique(rest[1]))[0]))])

    def survey(table: pa.Table) -> pa.Table:
        by = dict(mail(table))
        key, ids, prints = unpack(by[OPEN])
        label = label_of(ids, by.get(STATE))
        order = np.argsort(key, kind="stable")
        key, ids, prints, label = (x[order] for x in (key, ids, prints, label))
        cut = np.flatnonzero(firsts((key,)))
        value, low, high = key[cut], *(f.reduceat(label, cut) if len(cut) else label for f in (np.minimum, np.maximum))
        return post(me_of(table), [(to, pack(value[i], low[i], high[i])) for to, i in deal(shard_of(value, n), n)], [(MINE, pack(key, ids, prints, label))])

    def differ(table: pa.Table) -> pa.Table:
        got = [(src, unpack(raw)) for src, raw in mail(table) if src != MINE]
        if not got:
            return post(0, [])
        key, low, high = (np.concatenate([g[k] for _, g in got]) for k in range(3))
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(firsts((key[order],)))
        several = np.minimum.reduceat(low[order], cut) != np.maximum.reduceat(high[order], cut)
        say = np.empty(len(key), bool)
        say[order] = np.repeat(several, np.diff(np.append(cut, len(key))))
        at = np.cumsum([0, *(len(g[0]) for _, g in got)])
        return post(me_of(table), [(src, pack(g[0][say[a:b]])) for (src, g), a, b in zip(got, at[:-1], at[1:], strict=True)])

    def scatter(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = next((unpack(raw) for src, raw in mail(left) if src == MINE), None)
        told = [unpack(raw)[0] for _, raw in mail(right)]
        if mine is None or not told:
            return post(0, [])
        on = np.isin(mine[0], np.concatenate(told))
        key, ids, prints, label = (x[on] for x in mine)
        return post(me_of(left), [(to, pack(key[i], ids[i], prints[i], label[i])) for to, i in deal(shard_of(key, n), n)])

    def crowd(table: pa.Table) -> pa.Table:
        key, ids, prints, label = (np.concatenate(x) for x in zip(*(unpack(raw) for _, raw in mail(table)), strict=True))
        # Of equal texts of a bucket one is compared, the others hang on it.
        order = np.lexsort((ids, prints, key))
        key, ids, prints, label = (x[order] for x in (key, ids, prints, label))
        new = firsts((key, prints))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        copy = np.flatnonzero(label != label[head])
        out = [(to, pack(np.int8([EDGES]), ids[copy[i]], ids[head[copy[i]]])) for to, i in deal(block_of(ids[copy], n), n)]
        key, ids, label = key[new], ids[new], label[new]
        cut = np.flatnonzero(firsts((key,)))
        count = np.diff(np.append(cut, len(key)))
        several = np.minimum.reduceat(label, cut) != np.maximum.reduceat(label, cut)
        tiles, job, who, side, what = -(-count // TILE), [], [], [], []
        for a, m, g in zip(cut[several].tolist(), count[several].tolist(), tiles[several].tolist()):
            tile = np.arange(m) % g
            for p in range(g):
                for q in range(p, g):
                    for on, k in ((p, 0), (q, 1)) if p < q else ((p, 2),):
                        at = a + np.flatnonzero(tile == on)
                        who.append(at)
                        job.append(np.full(len(at), mix(key[a : a + 1] + _U(p << 32 | q))[0]))
                        side.append(np.full(len(at), k, np.int8))
        if who:
            at, job_, side_ = (np.concatenate(x) for x in (who, job, side))
            out += [(to, pack(np.int8([0]), job_[i], ids[at[i]], label[at[i]], side_[i])) for to, i in deal(block_of(ids[at], n), n)]
        return post(me_of(table), out)

    def ship(left: pa.Table, right: pa.Table) -> pa.Table:
        jobs = [got[1:] for _, raw in mail(right) if (got := unpack(raw))[0][0] == 0]
        if not left.num_rows or not jobs:
            return post(0, [])
        block = docs_of(left)
        job, ids, label, side = (np.concatenate(x) for x in zip(*jobs, strict=True))
        return post(me_of(left), [(to, pack(job[i], ids[i], label[i], side[i], _texts(block, _rows_of(block.ids, np.unique(ids[i]))[0]))) for to, i in deal(shard_of(job, n), n)])

    def compare(table: pa.Table) -> pa.Table:
        got = [unpack(raw) for _, raw in mail(table)]
        job, ids, label, side = (np.concatenate([g[k] for g in got]) for k in range(4))
        block = Block([g[4] for g in got])
        have = _features(block, size)
        order = np.argsort(job, kind="stable")
        cut = K.runs(job[order])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            some = order[lo:hi]
            parts_ = []
            for k in np.unique(side[some]).tolist():
                mine = some[side[some] == k]
                at, of = _rows_of(block.ids, ids[mine])
                parts_.append(([have[x] for x in at.tolist()], ids[mine][of], label[mine][of]))
            x, y = settle(parts_[0][0], parts_[1][0] if len(parts_) > 1 else None, [p[1] for p in parts_], [p[2] for p in parts_], threshold)
            a.append(x)
            b.append(y)
        x, y = np.concatenate(a), np.concatenate(b)
        return post(me_of(table), [(to, pack(np.int8([EDGES]), x[i], y[i])) for to, i in deal(block_of(x, n), n)])

    def again(table: pa.Table) -> pa.Table:
        own = label = np.zeros(0, np.int64)
        x, y = [], []
        for src, raw in mail(table):
            got = unpack(raw)
            if src == STATE:
                own, label = got[5:7]
            elif got[0][0] == EDGES:
                x.append(got[1])
                y.append(got[2])
        on, me = own != label, me_of(table)
        return post(me, [], [state_row(me, np.concatenate([own[on], *x]), np.concatenate([label[on], *y]))])

    go = to_all.exchange
    asked = go(dealt.groupBy("key").applyInArrow(ask, PACKED))
    judged = go(asked.groupBy("key").applyInArrow(judge, PACKED))
    linked = go(asked.groupBy("key").cogroup(judged.groupBy("key")).applyInArrow(link, PACKED))
    served = go(dealt.groupBy("key").cogroup(linked.groupBy("key")).applyInArrow(serve, PACKED))
    told = linked.where(F.col("src") == MINE).union(served)
    state = dealt.groupBy("key").cogroup(told.groupBy("key")).applyInArrow(verify, PACKED)
    first = written(few(state, docs))
    final_ = components(first.where(F.col("src") == STATE), to_all, docs)
    final = final_.where(F.col("src") == STATE)

    # What the leaders have not joined.
    surveyed = go(final.union(first.where(F.col("src") == OPEN)).repartition(n, "key").groupBy("key").applyInArrow(survey, PACKED))
    differing = go(surveyed.groupBy("key").applyInArrow(differ, PACKED))
    rest = go(surveyed.groupBy("key").cogroup(differing.groupBy("key")).applyInArrow(scatter, PACKED))
    crowded = written(few(rest.groupBy("key").applyInArrow(crowd, PACKED), docs))
    if not crowded.isEmpty():
        mine = go(crowded)
        texts = first.where(F.col("src") == TEXTS).repartition(n, "key")
        found = go(texts.groupBy("key").cogroup(mine.groupBy("key")).applyInArrow(ship, PACKED)).groupBy("key").applyInArrow(compare, PACKED)
        edges = written(few(found, docs))
        state = written(few(final.repartition(n, "key").union(mine).union(go(edges)).groupBy("key").applyInArrow(again, PACKED), docs))
        release(edges)
        release(final_)
        final = components(state, to_all, docs).where(F.col("src") == STATE)
        release(state)
    release(crowded)

    def result(table: pa.Table) -> pa.Table:
        by = dict(mail(table))
        (ids,) = unpack(by[IDS])
        return pa.table([id_column(ids), id_column(label_of(ids, by.get(STATE)))], names=["doc_id", "class_id"])

    return few(first.where(F.col("src") == IDS).union(final).repartition(n, "key").groupBy("key").applyInArrow(result, SCHEMA), docs)


def _salted(ids: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The order of leaders in a band."""
    return mix(ids.view(_U) + mix((band % SALTS).astype(_U) + _U(1)))


def _pick(order: np.ndarray, ids: np.ndarray, cut: np.ndarray, count: np.ndarray, least: np.ufunc) -> np.ndarray:
    """For each group the id of the least (or largest) order; its smallest, should two be equal."""
    best = np.repeat(least.reduceat(order, cut), count) == order
    return np.minimum.reduceat(np.where(best, ids, np.iinfo(np.int64).max), cut)


def _bucket_rows(key: np.ndarray, ids: np.ndarray, n: int, bands: int) -> list[tuple[int, bytes]]:
    """To each shard the distinct band keys of a block, each with the two ids that would lead here, and how many are here."""
    if not len(ids):
        return []
    flat = key.ravel()
    band = np.tile(np.arange(bands), len(ids))
    who = np.repeat(ids, bands)
    order = np.argsort(flat, kind="stable")
    flat, band, who = flat[order], band[order], who[order]
    cut = np.flatnonzero(firsts((flat,)))
    count = np.diff(np.append(cut, len(flat)))
    p = _salted(who, band)
    low, high = _pick(p, who, cut, count, np.minimum), _pick(p, who, cut, count, np.maximum)
    flat, band = flat[cut], band[cut].astype(np.int16)
    return [(to, pack(flat[i], low[i], high[i], band[i], count[i])) for to, i in deal(shard_of(flat, n), n)]
