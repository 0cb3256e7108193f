"""Shared plumbing: shared folder, written tables, document blocks, packed rows.

*Blocks.*  Several operators need facts about the whole corpus (which lines,
windows or words occur elsewhere) at the place where a document's text is.  They
deal the documents once, by a hash of ``doc_id``, into blocks; a block asks the
owners of its **distinct** keys and gets one answer per key back, however many of
its documents hold the key.  A key held by a third of all documents therefore costs
one request and one answer per block, never one per document.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED = "key long, src long, payload binary"
PACKED_ARROW = pa.schema([("key", pa.int64()), ("src", pa.int64()), ("payload", pa.binary())])
BUNDLE = -100  # in column src: the payload is letters (target or source, bytes) tied together
#: Bytes of input files in a block (conf segtable.llm.block_bytes), and of payloads in an Arrow batch.
BLOCK_BYTES, BATCH_BYTES = 128 << 20, 1 << 28
#: Up to so many blocks write to each other without routers (conf segtable.llm.direct).
DIRECT = 1024
NULL_ID = -(2**63)
NULL_LEN = 0xFFFFFFFF
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all runs on one machine (tests) a temporary one is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="segtable-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, so that lineage is cut.

    The folder goes by ``release``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/segtable-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.segtable_path = path
    return got


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete what ``written`` wrote for this very DataFrame; nothing may read it any more."""
    path = df.segtable_path
    remove(df.sparkSession, path)
    _written.remove((df.sparkSession, path))


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is the cluster's to clean
            return


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files and tables that a DataFrame is made from, as Spark knows them; None if it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return total if total < 1 << 60 else None


def few(df: DataFrame, docs: DataFrame, each: int = 8 << 20) -> DataFrame:
    """``df``, made from ``docs``, in tasks and files that stand for about ``each`` bytes of input or more.

    Tiny partitions are merged without a shuffle, but not to fewer than two for each core.  Where
    partitions are of a usual size nothing changes.
    """
    size = input_bytes(docs)
    return df if size is None else df.coalesce(min(2**31 - 1, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // each))))


def parts(spark: SparkSession) -> int:
    """The session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass(frozen=True)
class Net:
    """n blocks and n shards: the key of each (rows with this key are in a partition of their own), and how letters go."""

    n: int
    keys: np.ndarray
    direct: int
    size: int

    @property
    def width(self) -> int:
        """How many shards a group has."""
        return math.isqrt(self.n - 1) + 1

    def number(self, key: int) -> int:
        return int(np.flatnonzero(self.keys == key)[0])

    def me(self, table: pa.Table) -> int:
        """Which block or shard a group of rows is for."""
        return self.number(int(table.column("key")[0].as_py()))

    def post(self, me: int, letters: list[tuple[int, bytes]], own: list[tuple[int, bytes]] = ()) -> pa.Table:
        """Letters (to, bytes) of block ``me``; ``own`` are rows (src, bytes) that it keeps for itself."""
        out = [(int(self.keys[me]), src, raw) for src, raw in own]
        if self.n <= self.direct:
            return table_of(out + [(int(self.keys[to]), me, raw) for to, raw in letters])
        by: dict[int, list[tuple[int, bytes]]] = {}
        for to, raw in letters:
            by.setdefault(to // self.width, []).append((to, raw))
        routers = [(me % self.width * self.width + group) % self.n for group in by]
        return table_of(out + [(int(self.keys[r]), BUNDLE, bundle(me, some)) for r, some in zip(routers, by.values(), strict=True)])

    def route(self, table: pa.Table) -> pa.Table:
        """What a router does: letters of many blocks tied together for each shard."""
        out, by = [], {}
        for key, src, raw in zip(table.column("key").to_pylist(), table.column("src").to_pylist(), payloads(table), strict=True):
            if src != BUNDLE:
                out.append((key, src, raw))
                continue
            sender, some = unbundle(raw)
            for to, letter in some:
                by.setdefault(to, []).append((sender, letter))
        return table_of(out + [(int(self.keys[to]), BUNDLE, bundle(-1, some)) for to, some in by.items()])

    def exchange(self, df: DataFrame) -> DataFrame:
        """Letters to where they go."""
        if self.n > self.direct:
            df = df.repartition(self.n, "key").groupBy("key").applyInArrow(lambda t: self.route(t), PACKED)
        return df.repartition(self.n, "key")


def bundle(sender: int, letters: list[tuple[int, bytes]]) -> bytes:
    head = np.array([sender, len(letters), *(x for x, _ in letters), *(len(raw) for _, raw in letters)], np.int64).tobytes()
    return head + b"".join(raw for _, raw in letters)


def unbundle(raw: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    sender, n = np.frombuffer(raw, np.int64, 2).tolist()
    who, size = np.frombuffer(raw, np.int64, 2 * n, 16).reshape(2, n)
    at = 16 + 16 * n + np.concatenate([[0], np.cumsum(size)])
    return sender, [(x, raw[a:b]) for x, a, b in zip(who.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]


def mail(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Letters (sender, bytes), and rows that the block kept for itself (src, bytes)."""
    for src, raw in zip(table.column("src").to_pylist(), payloads(table), strict=True):
        if src == BUNDLE:
            yield from unbundle(raw)[1]
        else:
            yield src, raw


def net(docs: DataFrame, block_bytes: int | None = None) -> Net:
    """As many blocks as the input has ``block_bytes``, but at least the session's shuffle partitions."""
    conf = docs.sparkSession.conf
    each = block_bytes or int(conf.get("segtable.llm.block_bytes", str(BLOCK_BYTES)))
    size = input_bytes(docs)
    n = max(parts(docs.sparkSession), math.ceil((size or 0) / each))
    return Net(n, even_keys(n), int(conf.get("segtable.llm.direct", str(DIRECT))), size or 1 << 40)


def _murmur_long(x: np.ndarray) -> np.ndarray:
    """Spark's hash of a long (Murmur3, seed 42), to find keys that fill partitions evenly."""
    u32 = np.uint32

    def rot(v: np.ndarray, r: int) -> np.ndarray:
        return (v << u32(r)) | (v >> u32(32 - r))

    h = np.full(x.shape, 42, u32)
    x = x.astype(np.uint64)
    for half in (x.astype(u32), (x >> np.uint64(32)).astype(u32)):
        k = rot(half * u32(0xCC9E2D51), 15) * u32(0x1B873593)
        h = rot(h ^ k, 13) * u32(5) + u32(0xE6546B64)
    h ^= u32(8)
    h = (h ^ (h >> u32(16))) * u32(0x85EBCA6B)
    h = (h ^ (h >> u32(13))) * u32(0xC2B2AE35)
    return (h ^ (h >> u32(16))).view(np.int32)


def even_keys(n: int) -> np.ndarray:
    """n longs of which Spark's hash partitioning sends exactly one to each of n partitions."""
    found = np.full(n, -1, np.int64)
    at, step = 0, 16 * n + 64
    while (found < 0).any():
        x = np.arange(at, at + step, dtype=np.int64)
        p = _murmur_long(x).astype(np.int64) % n
        q, first = np.unique(p, return_index=True)
        new = found[q] < 0
        found[q[new]] = x[first[new]]
        at += step
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_parts(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):  # empty or too long for one chunk
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays, and byte strings, as one compressed byte string; integers by byte planes."""
    out = []
    for a in arrays:
        if isinstance(a, (bytes, memoryview)):
            kind, n, raw = b"*", len(a), bytes(a)
        else:
            kind, n = a.dtype.char.encode(), len(a)
            raw = np.ascontiguousarray(a.view(np.uint8).reshape(n, a.itemsize).T).tobytes() if n and a.itemsize > 1 else a.tobytes()
        z = zstandard.compress(raw, 1)
        out += [kind, np.int64([n, len(z)]).tobytes(), z]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray | bytes]:
    out, at = [], 0
    view = memoryview(data)
    while at < len(data):
        kind = data[at : at + 1].decode()
        n, size = np.frombuffer(view, np.int64, 2, at + 1)
        raw = zstandard.decompress(view[at + 17 : at + 17 + size]) if size else b""
        at += 17 + int(size)
        if kind == "*":
            out.append(raw)
        else:
            t = np.dtype(kind)
            a = np.frombuffer(raw, np.uint8)
            out.append(np.ascontiguousarray(a.reshape(t.itemsize, n).T).view(t).reshape(n) if t.itemsize > 1 and n else a.view(t))
    return out


def table_of(out: list[tuple[int, int, bytes]]) -> pa.Table:
    """Rows (key, src, payload) in batches of bounded size: an Arrow binary array ends at 2 GiB."""
    batches, a, size = [], 0, 0
    for b, (_, _, raw) in enumerate(out):
        if b > a and size + len(raw) > BATCH_BYTES:
            batches.append(_batch(out[a:b]))
            a, size = b, 0
        size += len(raw)
    return pa.Table.from_batches([*batches, _batch(out[a:])])


def _batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(PACKED_ARROW.types)]
    return pa.RecordBatch.from_arrays(columns, schema=PACKED_ARROW)


def deal(to: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of n targets that occurs in ``to``: the target and its row numbers."""
    order = np.argsort(to, kind="stable")
    sent = to[order]
    cut = np.concatenate([[0], np.flatnonzero(sent[1:] != sent[:-1]) + 1, [len(sent)]]) if len(sent) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(sent[a]), order[a:b]


def block_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Which of n blocks holds each document."""
    return (mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def blocks(docs: DataFrame, net_: Net, carry: Column | None = None) -> DataFrame:
    """The documents dealt into blocks by a hash of doc_id: rows (key, src, payload).

    A document is in one block whole, and rows with one doc_id are together.  The
    exchange is written once and used again by each branch of the plan that reads it.
    ``carry``: a value of any type that travels with each document (``Block.carry``), as it is.
    """
    n, keys, carried = net_.n, net_.keys, carry is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            to = block_of(ids, n)
            order = np.argsort(to, kind="stable")
            ids, sent, by = ids[order], to[order], pa.array(order)
            text = batch.column(1).cast(pa.large_binary()).take(by)
            buf, off = text_parts(text)
            size = np.where(text.is_null().to_numpy(zero_copy_only=False), NULL_LEN, np.diff(off)).astype(np.uint32)
            more = batch.select(["carry"]).take(by) if carried else None
            cut = np.concatenate([[0], np.flatnonzero(sent[1:] != sent[:-1]) + 1, [len(sent)]]).tolist()
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rest = [] if more is None else [_stream(more.slice(a, b - a))]
                out.append((int(keys[sent[a]]), 0, pack(ids[a:b], size[a:b], buf[off[a] : off[b]].tobytes(), *rest)))
            yield from table_of(out).to_batches()

    given = [] if carry is None else [carry.alias("carry")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *given).mapInArrow(run, PACKED).repartition(n, "key")


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as f:
        f.write_batch(batch)
    return sink.getvalue().to_pybytes()


def carrying(docs: DataFrame, schema: str, carry: Column | None) -> T.StructType:
    """The schema of a result that has what each document carries besides."""
    kind = T.StructType.fromDDL(schema)
    return kind if carry is None else kind.add("carry", docs.select(carry.alias("carry")).schema["carry"].dataType)


class Block:
    """Documents of one block, ordered by doc_id: ids, bytes, offsets, and which texts are null."""

    def __init__(self, payloads: list[bytes]):
        got = [unpack(p) for p in payloads]
        ids = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
        raw = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.uint32)
        missing, lens = raw == NULL_LEN, np.where(raw == NULL_LEN, 0, raw).astype(np.int64)
        buf = b"".join(g[2] for g in got)
        off = np.concatenate([[0], np.cumsum(lens)])
        order = np.argsort(ids, kind="stable")
        # The text is laid out in doc_id order, with eight bytes of padding for word-wise reads.
        self.ids, self.missing = ids[order], missing[order]
        view = memoryview(buf)
        self.bytes = b"".join(view[off[i] : off[i + 1]] for i in order) + b"\0" * 8
        self.off = np.concatenate([[0], np.cumsum(lens[order])])
        self.buf = np.frombuffer(self.bytes, np.uint8)
        self.carry: pa.ChunkedArray | None = None
        if got and len(got[0]) > 3:
            self.carry = pa.concat_tables(pa.ipc.open_stream(g[3]).read_all() for g in got).column("carry").take(pa.array(order))

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.bytes[self.off[i] : self.off[i + 1]]

    def chunks(self, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about ``size`` bytes; a longer document stands alone."""
        a = 0
        while a < len(self.ids):
            b = max(a + 1, int(np.searchsorted(self.off, self.off[a] + size, "right")) - 1)
            yield a, b
            a = b

    def id_column(self) -> pa.Array:
        return id_column(self.ids)

    def with_carry(self, table: pa.Table) -> pa.Table:
        """``table``, which has a row per document, with what the documents carry."""
        return table.append_column("carry", self.carry)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def payloads(table: pa.Table) -> list[bytes]:
    return table.column("payload").to_pylist()


def docs_of(table: pa.Table) -> Block:
    return Block(payloads(table))
