"""A hashed maximum-entropy language model with a class-factored softmax.

*Vocabulary.*  Every token of the training documents is counted, in blocks and shards.  The
``HEAD`` most frequent tokens form classes of ``WIDE`` neighbours in rank; all others, and
tokens never seen in training, belong to one of ``TAILS`` classes by the ending of the word.

*Model.*  P(token | history) = P(class | history) P(token | class, history).  Both factors are
maximum-entropy models on hashed features of the history: the token before (bigram), the one
before that (skip), and both together (trigram).  The feature tables grow with the corpus
(``table_rows``).  Within a tail class the counts of all its
tokens decide, with one symbol for whatever is unknown, so all probabilities sum to one.

*Pairs.*  Whole words are features too, however many there are: of each pair of neighbouring
tokens the corpus count is gathered in blocks and shards.  Indicators of all pairs have the pairs' relative
frequencies as their maximum-entropy weights, which need no steps; these are smoothed by a
Dirichlet prior whose mean is the model above: (c(pair) + k P) / (c(token before) + k).  As the
pairs of a token count up to its own count, all probabilities still sum to one.

*Training.*  Each worker gathers what follows each history in its share of the documents, takes
AdaGrad steps on these counts, and the workers' weights are averaged by a tree; the average
starts the next round.  All training documents take part.

*Scoring.*  Tokens of a block that share a history are scored together, then mixed with the pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .base import NULL_ID, PACKED, Block, Net, blocks, deal, docs_of, few, id_column, mail, mix, net, pack, payloads, table_of, unpack, written
from .buckets import firsts, shard_of, spans

_U = np.uint64
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
HEAD, WIDE, TAILS = 1024, 32, 64
CLASSES = HEAD // WIDE + TAILS
#: Feature tables have 2**LEAST_ROWS rows up to 2**27 training tokens, then twice as many for twice the tokens, up to 2**MOST_ROWS.
LEAST_ROWS, MOST_ROWS = 14, 17
BEGIN = HEAD + TAILS  # the symbol before a text
SYMBOLS = BEGIN + 1
STATS, CODED = -1, 0  # in column src of the coded table
END = _U(0x5E2D58D8B3BCDF1A)
PAIR = _U(0x2B7E151628AED2A6)
SLICES = 64
PRIOR = 1000.0
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOPS = np.isin(np.arange(256), list(b".,;:!?|"))


def tokens(block: Block, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents a to b: each token's hash and ending's class, and the documents' first tokens.

    Tokens are the words with A-Z in lower case, and one end for each document.
    """
    off = block.off[a : b + 1] - block.off[a]
    buf = _LOWER[block.buf[block.off[a] : block.off[b] + 8]]
    starts, ends, first = K.words(buf, off)
    n = len(starts)
    h = K.word_hashes(buf, starts, ends)
    stop = ends - np.where((ends - starts > 1) & _STOPS[buf[ends - 1]], 1, 0)
    ending = np.zeros(n, _U)
    for k in (1, 2, 3):
        at = stop - k
        ending = (ending << _U(8)) | np.where(at >= starts, buf[np.maximum(at, 0)], 0).astype(_U)
    tail = (mix(ending + _U(77)) % _U(TAILS)).astype(np.uint8)
    place = np.arange(n) + np.repeat(np.arange(b - a), np.diff(first))
    all_h, all_t = np.full(n + b - a, END), np.zeros(n + b - a, np.uint8)
    all_h[place], all_t[place] = h, tail
    return all_h, all_t, first + np.arange(b - a + 1)


def table_rows(tokens: int) -> tuple[int, int]:
    """Rows of the feature tables for classes and for members."""
    bits = min(MOST_ROWS, max(LEAST_ROWS, int(tokens).bit_length() - 28 + LEAST_ROWS))
    return 1 << bits, 1 << bits + 1


class _Coded:
    """A block as numbers into its own dictionary."""

    def __init__(self, block: Block, learn: np.ndarray):
        hs, ts, offs, base = [np.zeros(0, _U)], [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)], 0
        for a, b in block.chunks():
            h, t, off = tokens(block, a, b)
            hs.append(h)
            ts.append(t)
            offs.append(off[1:] + base)
            base += len(h)
        h, t, self.off = np.concatenate(hs), np.concatenate(ts), np.concatenate(offs)
        order = np.argsort(h)
        new = firsts((h[order],))
        number = np.empty(len(h), np.int32)
        number[order] = np.cumsum(new) - 1
        lead = order[new]
        by = np.argsort(-np.bincount(number, minlength=len(lead)), kind="stable")  # frequent tokens have small numbers, which pack well
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by))
        number = rank[number]
        self.code, self.hash, self.tail = number, h[lead[by]], t[lead[by]]
        seen = np.repeat(learn, np.diff(self.off))
        self.count = np.bincount(number[seen], minlength=len(self.hash)).astype(np.int64)


def _learned(block: Block, modulus: int, out: int) -> np.ndarray:
    """Which documents are learned from: crc32 of doc_id as text, modulo ``modulus``, is not ``out``."""
    return np.array([zlib.crc32(b"" if i == NULL_ID else b"%d" % i) % modulus != out for i in block.ids.tolist()], bool)


def _summed(got: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """For blocks that told distinct keys and counts, each key's sum over all blocks and whether several told it.  Also the order of all keys, where each begins, and its sum."""
    h, c = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(h)
    cut = np.flatnonzero(firsts((h[order],)))
    total = np.add.reduceat(c[order], cut) if len(cut) else c[:0]
    size = np.diff(np.append(cut, len(h)))
    each, several = np.empty(len(h), np.int64), np.empty(len(h), bool)
    each[order], several[order] = np.repeat(total, size), np.repeat(size > 1, size)
    at = np.cumsum([len(x[0]) for x in got])[:-1]
    return list(zip(np.split(each, at), np.split(several, at), strict=True)), order, cut, total


def coded(docs: DataFrame, modulus: int, out: int, net_: Net | None = None) -> DataFrame:
    """The documents as dictionary numbers with corpus counts, and each shard's statistics; written."""
    to_all = net_ or net(docs)
    n, me_of = to_all.n, to_all.me
    dealt = blocks(docs, to_all)

    def ask(table: pa.Table) -> pa.Table:
        block = docs_of(table)
        c = _Coded(block, _learned(block, modulus, out))
        return to_all.post(me_of(table), [(k, pack(c.hash[i], c.count[i], c.tail[i])) for k, i in deal(shard_of(c.hash, n), n)])

    def judge(table: pa.Table) -> pa.Table:
        got = [(src, unpack(raw)) for src, raw in mail(table)]
        if not got:
            return to_all.post(0, [])
        t = np.concatenate([x[2] for _, x in got])
        answers, order, cut, total = _summed([x[:2] for _, x in got])
        letters = [(src, pack(each, several.astype(np.uint8))) for (src, _), (each, several) in zip(got, answers, strict=True)]
        h = np.concatenate([x[0] for _, x in got])
        known = total > 0
        lead, tail, total = h[order[cut]][known], t[order[cut]][known], total[known]
        top = np.lexsort((lead, -total))[:HEAD]
        sums = np.bincount(tail, total, TAILS).astype(np.int64), np.bincount(tail, minlength=TAILS).astype(np.int64)
        return to_all.post(me_of(table), letters, [(STATS, pack(*sums, lead[top], total[top], tail[top]))])

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        me, told = me_of(left if left.num_rows else right), list(mail(right))
        own = [(STATS, raw) for src, raw in told if src == STATS]
        if left.num_rows:
            block = docs_of(left)
            learn = _learned(block, modulus, out)
            c = _Coded(block, learn)
            total, several = np.zeros(len(c.hash), np.int64), np.zeros(len(c.hash), np.uint8)
            answer = {src: unpack(raw) for src, raw in told if src >= 0}
            for k, i in deal(shard_of(c.hash, n), n):
                total[i], several[i] = answer[k]
            own.append((CODED, pack(block.ids, learn.astype(np.uint8), np.diff(c.off).astype(np.int32), c.code, c.hash, total, c.tail, several)))
        return to_all.post(me, [], own)

    asked = to_all.exchange(dealt.groupBy("key").applyInArrow(ask, PACKED))
    judged = to_all.exchange(asked.groupBy("key").applyInArrow(judge, PACKED))
    return written(few(dealt.groupBy("key").cogroup(judged.groupBy("key")).applyInArrow(close, PACKED), docs))


class _Pairs:
    """The distinct pairs of neighbouring tokens of a coded block.

    Where one of the two tokens is in no other block, learned from or not, the block's own count
    of the pair is the corpus count; the others (``asked``) are told and asked for.
    """

    def __init__(self, raw: bytes):
        _, learn, size, code, h, total, _, several = unpack(raw)
        seen = np.repeat(learn > 0, size)
        follows = np.ones(len(code), bool)
        follows[np.cumsum(size[:-1], dtype=np.int64)] = False
        follows[:1] = False
        self.at = np.flatnonzero(follows)
        pair = code[self.at - 1].astype(np.int64) * len(h) + code[self.at]
        order = np.argsort(pair)
        new = firsts((pair[order],))
        self.number = np.empty(len(pair), np.int32)
        self.number[order] = np.cumsum(new) - 1
        left, right = np.divmod(pair[order[new]], max(1, len(h)))
        self.count = np.bincount(self.number[seen[self.at]], minlength=len(left)).astype(np.int64)
        more = (several > 0) & (total > 0)
        asked = np.flatnonzero(more[left] & more[right])
        hashes = mix(h[left[asked]] + PAIR) ^ h[right[asked]]
        order = np.argsort(hashes)  # so that letters tell only differences
        self.asked, self.hash = asked[order], hashes[order]

    def counts(self, n_tokens: int) -> np.ndarray:
        """Each token's corpus count together with the token before, 0 for first ones."""
        out = np.zeros(n_tokens, np.int64)
        out[self.at] = self.count[self.number]
        return out


def paired(table: DataFrame, to_all: Net) -> DataFrame:
    """Answers to each block of a coded table: corpus counts of the pairs it asks for."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                p = _Pairs(raw)
                count = p.count[p.asked]
                yield from to_all.post(to_all.number(key), [(k, pack(np.diff(p.hash[i], prepend=_U(0)), count[i])) for k, i in deal(shard_of(p.hash, to_all.n), to_all.n)]).to_batches()

    def judge(some: pa.Table) -> pa.Table:
        got = [(src, unpack(raw)) for src, raw in mail(some)]
        answers = _summed([(np.cumsum(h, dtype=_U), c) for _, (h, c) in got])[0] if got else []
        return to_all.post(to_all.me(some), [(src, pack(each)) for (src, _), (each, _) in zip(got, answers, strict=True)])

    asked = to_all.exchange(table.where(F.col("src") == CODED).mapInArrow(ask, PACKED))
    return to_all.exchange(asked.groupBy("key").applyInArrow(judge, PACKED))


@dataclass
class Vocabulary:
    """N, V, the head by descending count, and per tail class its tokens and distinct tokens besides the head."""

    total: int
    distinct: int
    head: np.ndarray
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_distinct: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.head)
        n = np.zeros(HEAD)
        n[: len(self.counts)] = self.counts + 1.0
        sums = n.reshape(-1, WIDE).sum(1)
        mass = np.concatenate([sums, self.tail_tokens + self.tail_distinct + 1.0])
        with np.errstate(divide="ignore"):
            self.bias1 = np.where(mass > 0, np.log(mass), -np.inf).astype(np.float32)
            self.bias2 = np.where(n > 0, np.log(n), -np.inf).reshape(-1, WIDE).astype(np.float32)

    def symbols(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The rank of a head token, HEAD and the class of another."""
        out = tail.astype(np.int32) + HEAD
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head[self.order], h), len(self.head) - 1)
            hit = self.head[self.order[at]] == h
            out[hit] = self.order[at[hit]]
        return out


def vocabulary(table: DataFrame) -> Vocabulary:
    """From the shards' statistics: sums per class, and the HEAD largest counts of all shards."""
    stats = table.where(F.col("src") == STATS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for batch in batches:
            for raw in batch.column(2).to_pylist():
                more = unpack(raw)
                n += more[0]
                v += more[1]
        yield pa.RecordBatch.from_arrays([pa.array(range(TAILS)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(2).to_pylist():
                h, n, t = unpack(raw)[2:]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(t.astype(np.int64))], names=["h", "n", "t"])

    n, v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in stats.mapInArrow(sums, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    top = stats.mapInArrow(tops, "h long, n long, t long").orderBy(F.desc("n"), "h").limit(HEAD).collect()
    head, counts, tail = (np.array([r[c] for r in top], np.int64) for c in ("h", "n", "t"))
    total, distinct = int(n.sum()), int(v.sum())
    np.subtract.at(n, tail, counts)
    np.subtract.at(v, tail, 1)
    return Vocabulary(total, distinct, head.view(_U), counts, n, v)


@dataclass
class Weights:
    """Rows of hashed features: for classes, and for the members of a head class."""

    classes: np.ndarray
    members: np.ndarray


def _rows1(context: np.ndarray, rows: int) -> list[np.ndarray]:
    """Feature rows of a history, which is SYMBOLS * previous + one before."""
    s1, s2 = context // SYMBOLS, context % SYMBOLS
    free = rows - 2 * SYMBOLS
    both = 2 * SYMBOLS + (mix(context.astype(_U) + _U(3)) % _U(free)).astype(np.int64)
    return [s1, SYMBOLS + s2, both]


def _rows2(context: np.ndarray, cls: np.ndarray, rows: int) -> list[np.ndarray]:
    s1, s2 = context // SYMBOLS, context % SYMBOLS
    salt = cls.astype(_U) << _U(40)
    return [(mix(x.astype(_U) + salt + _U(k << 56)) % _U(rows)).astype(np.int64) for k, x in ((1, s1), (2, s2), (3, context))]


def _logits(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = table[rows[0]]
    for r in rows[1:]:
        z += table[r]
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def _histories(sym: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each token SYMBOLS times the symbol before it plus the one before that."""
    s1 = np.empty(len(sym), np.int64)
    s1[1:] = sym[:-1]
    s1[off[:-1]] = BEGIN
    s2 = np.empty(len(sym), np.int64)
    s2[1:] = s1[:-1]
    s2[off[:-1]] = BEGIN
    return s1 * SYMBOLS + s2


class _Share:
    """What follows each history in a worker's share of the training documents."""

    def __init__(self) -> None:
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.tokens = 0

    def add(self, context: np.ndarray, sym: np.ndarray) -> None:
        self.tokens += len(sym)
        key = np.sort(context << 11 | sym)
        cut = K.runs(key)
        self.pairs.append((key[cut[:-1]], np.diff(cut).astype(np.int32)))
        if sum(len(k) for k, _ in self.pairs[1:]) > max(1 << 19, len(self.pairs[0][0]) // 2):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        key, n = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        del order
        cut = np.flatnonzero(firsts((key,)))
        self.pairs = [(key[cut], np.add.reduceat(n, cut) if len(cut) else n)]
        return self.pairs[0]


def _descend(table: np.ndarray, groups: np.ndarray, member: np.ndarray, n: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, passes: int, rate: float, ridge: float, batch: int = 8192) -> None:
    """AdaGrad on counted events, in place: event e is ``member[e]`` after history ``groups[e]``, n[e] times.

    ``rows`` and ``bias`` are those of the histories, events are in order of ``groups``.
    """
    m = len(rows[0])
    if not m:
        return
    square = np.full(table.shape, 1e-2, np.float32)
    cut = np.searchsorted(groups, np.arange(m + 1))
    size = np.add.reduceat(n, cut[:-1]).astype(np.float32)
    order = np.random.default_rng(11).permutation(m)
    for _ in range(passes):
        for a in range(0, m, batch):
            at = order[a : a + batch]
            some = [r[at] for r in rows]
            p = np.exp(_logits(bias if bias.ndim == 1 else bias[at], table, some))
            p *= (size[at] / p.sum(1))[:, None]
            events = spans(cut[at], cut[at + 1])
            p[np.repeat(np.arange(len(at)), cut[at + 1] - cut[at]), member[events]] -= n[events]
            for r in some:
                by = np.argsort(r, kind="stable")
                first = np.flatnonzero(firsts((r[by],)))
                g = np.add.reduceat(p[by], first, axis=0)
                u = r[by[first]]
                w = table[u]
                g += ridge * w
                s = square[u]
                s += g * g
                square[u] = s
                np.sqrt(s, out=s)
                g /= s
                g *= rate
                table[u] = w - g


def train_share(share: _Share, words: Vocabulary, start: Weights, passes: int, rate: float, ridge: float) -> Weights:
    """Weights after steps on one share."""
    key, n = share.settle()
    w = Weights(start.classes.copy(), start.members.copy())
    sym = (key & 2047).astype(np.int16)
    cls = np.where(sym < HEAD, sym // WIDE, HEAD // WIDE + sym - HEAD).astype(np.int16)
    # Symbols are in order of class within a history.
    first = np.flatnonzero(firsts((key >> 11, cls)))
    count = np.add.reduceat(n, first) if len(first) else n
    c, k = key[first] >> 11, cls[first]
    new = firsts((c,))
    _descend(w.classes, np.cumsum(new) - 1, k, count, _rows1(c[new], len(w.classes)), words.bias1, passes, rate, ridge)
    on = sym < HEAD
    c, sym, cls, n = key[on] >> 11, sym[on], cls[on], n[on]
    new = firsts((c, cls))
    _descend(w.members, np.cumsum(new) - 1, sym % WIDE, n, _rows2(c[new], cls[new], len(w.members)), words.bias2[cls[new]], passes, rate, ridge)
    return w


def _share_rows(raw: bytes, words: Vocabulary, chunk: int = 1 << 18) -> Iterator[tuple]:
    """A coded block in chunks of documents: ids, learned, tokens' offsets, codes, symbols, the dictionary's symbols and counts, where the tokens are in the block."""
    ids, learn, size, code, h, total, tail, _ = unpack(raw)
    sym = words.symbols(h, tail)
    off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(off, off[a] + chunk, "right")) - 1)
        mine = code[off[a] : off[b]]
        yield ids[a:b], learn[a:b] > 0, off[a : b + 1] - off[a], mine, sym[mine], sym, total, slice(off[a], off[b])
        a = b


def train(table: DataFrame, words: Vocabulary, rounds: int = 2, passes: int = 1, rate: float = 0.25, ridge: float = 0.05, share_tokens: int = 4 << 20, fan: int = 16) -> Weights:
    """Rounds of local steps and averaging.  A share has about ``share_tokens`` tokens."""
    spark = table.sparkSession
    groups = max(1, math.ceil(words.total / share_tokens))
    mine = table.where(F.col("src") == CODED)
    rows1, rows2 = table_rows(words.total)
    w = Weights(np.zeros((rows1, CLASSES), np.float32), np.zeros((rows2, WIDE), np.float32))
    flat = rows1 * CLASSES + rows2 * WIDE
    edge = np.linspace(0, flat, SLICES + 1).astype(np.int64)

    def steps(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            share, (words_, start) = _Share(), shared.value
            for batch in batches:
                for raw in batch.column(2).to_pylist():
                    for _, learn, off, _, sym, _, _, _ in _share_rows(raw, words_):
                        on = np.repeat(learn, np.diff(off))
                        share.add(_histories(sym, off)[on], sym[on])
            if share.tokens:
                got = train_share(share, words_, start, passes, rate, ridge)
                moved = np.concatenate([(got.classes - start.classes).ravel(), (got.members - start.members).ravel()]).astype(np.float16)
                node = TaskContext.get().partitionId() // fan
                yield from table_of([(k * (groups + 1) + node, share.tokens, pack(moved[edge[k] : edge[k + 1]])) for k in range(SLICES)]).to_batches()

        return run

    def average(some: pa.Table) -> pa.Table:
        weight = np.array(some.column("src").to_pylist(), np.float64)
        total = sum(x * unpack(p)[0].astype(np.float64) for x, p in zip(weight, payloads(some), strict=True)) / weight.sum()
        k, node = divmod(int(some.column("key")[0].as_py()), groups + 1)
        return table_of([(k * (groups + 1) + node // fan, int(weight.sum()), pack(total.astype(np.float32)))])

    for _ in range(rounds if words.total else 0):
        shared = spark.sparkContext.broadcast((words, w))  # at most 2**MOST_ROWS rows of CLASSES and twice as many of WIDE
        got = mine.coalesce(groups).mapInArrow(steps(shared), PACKED)
        width = math.ceil(groups / fan)
        while True:
            got = got.groupBy("key").applyInArrow(average, PACKED)
            if width == 1:
                break
            width = math.ceil(width / fan)
        moved = np.zeros(flat, np.float32)
        for r in got.collect():  # one row for each slice of the weights
            k = r["key"] // (groups + 1)
            moved[edge[k] : edge[k + 1]] = unpack(bytes(r["payload"]))[0]
        cut = rows1 * CLASSES
        w = Weights(w.classes + moved[:cut].reshape(w.classes.shape), w.members + moved[cut:].reshape(w.members.shape))
    return w


def log_probabilities(context: np.ndarray, sym: np.ndarray, words: Vocabulary, w: Weights, batch: int = 8192) -> np.ndarray:
    """Natural logarithm of the probability of each symbol after its history."""
    out = np.zeros(len(sym), np.float64)
    cls = np.where(sym < HEAD, sym // WIDE, HEAD // WIDE + sym - HEAD)

    def factor(at: np.ndarray, key: np.ndarray, rows, bias, table: np.ndarray, member: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        cut = K.runs(key[order])
        for a in range(0, len(cut) - 1, batch):
            b = min(a + batch, len(cut) - 1)
            k = key[order[cut[a:b]]]
            z = _logits(bias(k), table, rows(k))
            z -= np.log(np.exp(z).sum(1, dtype=np.float64))[:, None].astype(np.float32)
            some = order[cut[a] : cut[b]]
            out[at[some]] += z[np.repeat(np.arange(b - a), np.diff(cut[a : b + 1])), member[some]]

    every = np.arange(len(sym))
    factor(every, context, lambda k: _rows1(k, len(w.classes)), lambda k: words.bias1, w.classes, cls)
    head = np.flatnonzero(sym < HEAD)
    factor(head, context[head] << 5 | cls[head], lambda k: _rows2(k >> 5, k & 31, len(w.members)), lambda k: words.bias2[k & 31], w.members, sym[head] % WIDE)
    return out


def score(table: DataFrame, words: Vocabulary, w: Weights, to_all: Net, prior: float = PRIOR) -> DataFrame:
    """Base and model scores of each document of a coded table.  ``prior``: what the model counts beside the pairs after a token."""
    shared = table.sparkSession.sparkContext.broadcast((words, w))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v, weights = shared.value
        spread = v.tail_tokens + v.tail_distinct + 1.0
        answer, out = {src: unpack(raw)[0] for src, raw in mail(right)}, [SCORED.empty_table()]
        for raw in payloads(left):
            pairs = _Pairs(raw)
            for k, i in deal(shard_of(pairs.hash, to_all.n), to_all.n):
                pairs.count[pairs.asked[i]] = answer[k]
            pair = pairs.counts(int(unpack(raw)[2].sum()))
            del pairs
            for ids, learn, off, code, sym, all_sym, total, place in _share_rows(raw, v):
                base = np.log10((total + 1.0) / (v.total + 1.0 * (v.distinct + 1)))
                within = np.where(all_sym < HEAD, 0.0, np.log((total + 1.0) / spread[np.maximum(all_sym - HEAD, 0)]))
                each = log_probabilities(_histories(sym, off), sym, v, weights) + within[code]
                before = np.concatenate([[0], total[code[:-1]]])
                before[off[:-1]] = 0
                each = np.log((pair[place] + prior * np.exp(each)) / (before + prior))
                known = (total > 0)[code]
                sums = [np.add.reduceat(x, off[:-1]) if len(off) > 1 else x[:0] for x in (known.astype(np.int64), base[code], each)]
                n = len(ids)
                out.append(pa.Table.from_arrays([id_column(ids), pa.array(~learn), pa.array(np.diff(off)), pa.array(sums[0]), pa.array(np.full(n, v.total, np.int64)), pa.array(sums[1]), pa.array(sums[2] / math.log(10))], schema=SCORED))
        return pa.concat_tables(out)

    mine = table.where(F.col("src") == CODED).repartition(to_all.n, "key")
    return mine.groupBy("key").cogroup(paired(table, to_all).groupBy("key")).applyInArrow(run, SCHEMA)


def score_documents(docs: DataFrame, modulus: int = 7, out: int = 2) -> DataFrame:
    """Learn from the documents whose crc32(doc_id as text) modulo ``modulus`` is not ``out``; score all.

    Tokens: words with A-Z in lower case, and one end per document; a null or empty text has the
    end only.  ``base_score``: the sum over tokens of log10((c + 1) / (N + V + 1)).  ``score``: log10 of
    the model's probability of the text, of which the counts of whole pairs are part.  Words are told apart by 64-bit hashes.

    Repeated rows are learned from and scored each; a null doc_id counts as the empty text in the
    split.  Other columns are not looked at.  If nothing can be learned from, N and V are 0 and
    the model is uniform over its classes.  An empty table gives no rows.
    """
    to_all = net(docs)
    table = coded(docs, modulus, out, to_all)
    words = vocabulary(table)
    return score(table, words, train(table, words), to_all)

