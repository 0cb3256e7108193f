"""Exact top-k by integer inner product: tiles of queries and shards, merged as a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import PACKED, deal, even_keys, mix, pack, parts, payloads, table_of, unpack

SCHEMA = "query_id long, rank int, vec_id long, score long"
_U = np.uint64
_LIMIT = 2.0**62


def usable(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By dimension: ids and floor(256 x) of the rows that take part; of large ones x itself, as doubles."""
    if pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    rows = np.flatnonzero((ids.is_valid().to_numpy(zero_copy_only=False)) & (vectors.is_valid().to_numpy(zero_copy_only=False)))
    if not len(rows):
        return
    ids, vectors = ids.take(pa.array(rows)), vectors.take(pa.array(rows))
    raw = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(raw * 256.0)
        wrong, large = (np.concatenate([[0], np.cumsum(~x)]) for x in (np.isfinite(raw), np.abs(flat) < _LIMIT))
    end = np.cumsum(size)
    good = (wrong[end] == wrong[end - size]) & (size > 0)
    big = large[end] > large[end - size]
    number = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(size[good]):
        for some, values in ((good & ~big, flat), (good & big, raw)):
            at = np.flatnonzero(some & (size == d))
            if len(at):
                got = values[(end[at] - d)[:, None] + np.arange(d)]
                yield int(d), number[at], got if values is raw else got.astype(np.int64)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles, or integers themselves, as Python integers, which have any size."""
    if x.dtype != np.float64:
        return x.astype(object)
    out = [int(v) * 256 if abs(v) >= 2.0**53 else math.floor(v * 256.0) for v in x.ravel().tolist()]  # from 2**53 on a double is whole
    whole = np.empty(x.size, object)
    whole[:] = out
    return whole.reshape(x.shape)


def pack_scores(s: np.ndarray) -> np.ndarray | bytes:
    """Scores as longs, or as text where one is no long."""
    if s.dtype == object and any(not -(2**63) <= v < 2**63 for v in s.tolist()):
        return ",".join(map(str, s.tolist())).encode()
    return s.astype(np.int64)


def unpack_scores(x: np.ndarray | bytes) -> np.ndarray:
    return np.array([int(v) for v in x.split(b",")], object) if isinstance(x, bytes) else x


def best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places in c of its k best, best first, and their scores; -1 where there are fewer.

    c is in order of c_ids, so that ties go to the smaller id.  Never the query's own id.
    """
    n = len(c)
    take = min(k, n)
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    own = q_ids[:, None] == c_ids[None, :]
    if top * 2 * n < 2.0**52 and q.dtype != np.float64 and c.dtype != np.float64:
        score = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        key = score * n + (n - 1 - np.arange(n))
        key[own] = np.iinfo(np.int64).min
        at = np.argpartition(key, n - take, axis=1)[:, n - take :] if take < n else np.tile(np.arange(n), (len(q), 1))
        picked = np.take_along_axis(key, at, 1)
        order = np.argsort(-picked, axis=1, kind="stable") if take else at
        at = np.take_along_axis(at, order, 1)
    else:  # too large for exact doubles
        score = integers(q) @ integers(c).T
        at = np.array([sorted(range(n), key=lambda j: (own[i, j], -row[j], j))[:take] for i, row in enumerate(score)], np.int64).reshape(len(q), take)
    picked = np.take_along_axis(score, at, 1)
    at = np.where(np.take_along_axis(own, at, 1), -1, at)
    if take < k:
        fill = ((0, 0), (0, k - take))
        at, picked = np.pad(at, fill, constant_values=-1), np.pad(picked, fill)
    return at, picked


def merged(parts_: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One list per query from several: arrays of queries, ids and scores, one entry a row."""
    q, v, s = (np.concatenate(x) for x in zip(*parts_, strict=True))
    if s.dtype == object:  # their order by number, as large ones have no negative long
        rank = {x: i for i, x in enumerate(sorted(set(s.tolist()), reverse=True))}
        down = np.array([rank[x] for x in s.tolist()], np.int64)
    else:
        down = ~s
    order = np.lexsort((v, down, q))
    q, v, s = q[order], v[order], s[order]
    start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    nth = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else q
    on = nth < k
    return q[on], v[on], s[on]


def _lists(table: pa.Table) -> list[tuple[np.ndarray, ...]]:
    got = [unpack(p) for p in payloads(table)]
    return [(q, v, unpack_scores(s)) for q, v, s in got]


def _queries(some: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query once, with the smallest of its vectors; small and large ones apart."""
    if len(some) > 1:  # an id may be among both
        twice = set(np.intersect1d(some[0][0], some[1][0]).tolist())
        first = {i: min(tuple(integers(v[k : k + 1])[0]) for ids, v in some for k in np.flatnonzero(ids == i).tolist()) for i in twice}
        some = [(ids[on], v[on]) for ids, v in some for on in [np.array([i not in first or tuple(integers(v[k : k + 1])[0]) == first[i] for k, i in enumerate(ids.tolist())], bool)]]
    out = []
    for ids, v in some:
        if v.dtype == np.float64:
            order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], tuple(integers(v[k : k + 1])[0]))), np.int64)
        else:
            order = np.lexsort((*v.T[::-1], ids))
        ids, v = ids[order], v[order]
        one = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
        out.append((ids[one], v[one]))
    return out


def bounded(letters: Iterator[tuple[int, int, bytes]], most: int = 64 << 20) -> Iterator[list[tuple[int, int, bytes]]]:
    """Letters in lists of about ``most`` bytes."""
    some, size = [], 0
    for x in letters:
        if some and size + len(x[2]) > most:
            yield some
            some, size = [], 0
        some.append(x)
        size += len(x[2])
    if some:
        yield some


def top_k(vectors: DataFrame, queries: Column, k: int = 5, query_bytes: int = 64 << 20, shard_bytes: int = 256 << 20, fan: int = 8) -> DataFrame:
    """The k highest inner products of each row that ``queries`` selects with all other rows.

    ``vectors``: vec_id and embedding.  Components are floor(256 x).  Queries are dealt into
    groups of about ``query_bytes`` (8 bytes a component), candidates into shards of about ``shard_bytes``
    (fewer on small tables, so that all cores work); each pair of a group and a shard is one tile: a
    matrix product and a partial selection.  The tiles' lists are merged ``fan`` at a time.
    A task holds one tile, whatever the table's size; no list is ever cut before its merge.  A group
    goes to each shard's tile and a shard to each group's; copies are sent off in batches of bounded size.

    Rows with a null vec_id, or a vector that is null, empty or holds a null or non-finite
    component take no part.  Only vectors of one length are compared.  Ties go to the smaller
    vec_id.  A query is never its own candidate: rows that repeat its vec_id are not either, and
    a repeated query is answered once, for the smallest of its vectors.  Components and scores of any
    size are compared exactly; a score beyond a long is given as the nearest.  An empty table gives none.
    """
    spark = vectors.sparkSession
    asks = F.coalesce(queries, F.lit(False))
    size = F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0))
    total, cells, cells_asked = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(asks, size)), F.lit(0))).first()
    n = parts(spark)
    groups = max(1, math.ceil(8 * cells_asked / query_bytes))
    shards = max(1, math.ceil(8 * cells / shard_bytes), math.ceil(n / groups) if total > 20 * n else 1)
    tiles = groups * shards
    keys = even_keys(tiles) if tiles <= 65536 else np.arange(tiles)
    cols = vectors.selectExpr("cast(vec_id as long) vec_id", "embedding")
    asked = vectors.where(queries).selectExpr("cast(vec_id as long) vec_id", "embedding")

    def dealt(as_query: bool):
        mine, others, salt = (groups, shards, 1) if as_query else (shards, groups, 2)

        def letters(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
            for d, ids, values in usable(batch.column(0), batch.column(1)):
                for a, at in deal((mix(ids.view(_U) + _U(salt)) % _U(mine)).astype(np.int64), mine):
                    small = values[at].astype(np.int32) if values.dtype == np.int64 and np.abs(values[at]).max() < 2**31 else values[at]
                    payload = pack(np.int64([d, as_query]), ids[at], small.ravel())
                    for b in range(others):
                        tile = a * shards + b if as_query else b * shards + a
                        yield int(keys[tile]), tile, payload

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in bounded(letters(batch)):
                    yield from table_of(some).to_batches()

        return run

    def tile(table: pa.Table) -> pa.Table:
        by: dict[tuple[int, bool, bool], list] = {}
        for p in payloads(table):
            head, ids, flat = unpack(p)
            by.setdefault((int(head[0]), bool(head[1]), flat.dtype == np.float64), []).append((ids, flat.reshape(len(ids), -1)))
        src = int(table.column("src")[0].as_py())
        found = []
        for d in sorted({d for d, is_query, _ in by if is_query}):
            asks_ = _queries([tuple(np.concatenate(x) for x in zip(*by[d, True, big], strict=True)) for big in (False, True) if (d, True, big) in by])
            for big in (False, True):
                if (d, False, big) not in by:
                    continue
                c_ids, c = (np.concatenate(x) for x in zip(*by[d, False, big], strict=True))
                order = np.argsort(c_ids, kind="stable")
                c_ids, c = c_ids[order], c[order]
                for q_ids, q in asks_:
                    for a in range(0, len(q), 512):
                        lists = []
                        for b in range(0, len(c), 4096):
                            at, score = best(q[a : a + 512], q_ids[a : a + 512], c[b : b + 4096], c_ids[b : b + 4096], k)
                            on = at >= 0
                            lists.append((np.broadcast_to(q_ids[a : a + 512, None], at.shape)[on], c_ids[b : b + 4096][at[on]], score[on]))
                        found.append(merged(lists, k))
        if not found:
            return table_of([])
        group, shard = divmod(src, shards)
        q, v, s = merged(found, k)
        return table_of([(group * level_size[0] + shard // fan, shard // fan, pack(q, v, pack_scores(s)))])

    def merge(level: int):
        def run(table: pa.Table) -> pa.Table:
            node = int(table.column("src")[0].as_py())
            key = int(table.column("key")[0].as_py())
            q, v, s = merged(_lists(table), k)
            group = key // level_size[level]
            return table_of([(group * level_size[level + 1] + node // fan, node // fan, pack(q, v, pack_scores(s)))])

        return run

    level_size = [math.ceil(shards / fan)]
    while level_size[-1] > 1:
        level_size.append(math.ceil(level_size[-1] / fan))
    level_size.append(1)

    def last(table: pa.Table) -> pa.Table:
        q, v, s = merged(_lists(table), k)
        if s.dtype == object:
            s = np.array([max(-(2**63), min(2**63 - 1, x)) for x in s.tolist()], np.int64)
        start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) + 1 if len(q) else q
        return pa.table([q, rank.astype(np.int32), v, s], names=["query_id", "rank", "vec_id", "score"])

    both = asked.mapInArrow(dealt(True), PACKED).union(cols.mapInArrow(dealt(False), PACKED))
    found = both.repartition(min(tiles, max(n, 1)) if tiles <= n else n, "key").groupBy("key").applyInArrow(tile, PACKED)
    for level in range(len(level_size) - 2):
        found = found.groupBy("key").applyInArrow(merge(level), PACKED)
    return found.groupBy("key").applyInArrow(last, SCHEMA)
