"""Nested records as numbered columns and back.

A record's fields are numbered depth first: a scalar takes one number, a struct the numbers of
its fields, a list one for its count and those of its elements; a void takes none.  *Streams* are
rows (key, id, pos, v): the value of column ``id`` in record ``key`` at the list places ``pos``.  In order
of (id, key, pos) they are the columns that a segment table stores.

A struct field with metadata ``{"union": true}`` keeps its numbers but is not stored.

Both ways work on whole Arrow columns of a batch of records: a level of lists is one array of values
and one of counts, whatever record they are of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from segtable.functions import binary, scalars

DEEPEST = 256
#: How scalars are stored.  Void has no column.
LETTER = {"smallint": "h", "int": "i", "bigint": "q", "decimal(20,0)": "Q", "float": "f", "double": "d", "string": "s", "binary": "s"}


def field_count(kind: T.DataType, depth: int = 0) -> int:
    """How many numbers a type takes."""
    if depth > DEEPEST:
        raise ValueError("the type is nested too deeply")
    if isinstance(kind, T.NullType):
        return 0
    if isinstance(kind, T.StructType):
        return sum(field_count(f.dataType, depth + 1) for f in kind)
    if isinstance(kind, T.ArrayType):
        return 1 + field_count(kind.elementType, depth + 1)
    if isinstance(kind, T.MapType):
        raise ValueError("a map has no columns")
    return 1


def _letter(field: T.DataType, letter: str | None) -> str:
    if letter:
        return letter
    try:
        return LETTER[field.simpleString()]
    except KeyError:
        raise ValueError(f"{field.simpleString()} can't be stored") from None


def _plain(kind: T.DataType, letter: str | None, union: bool, stored: bool) -> T.DataType:
    """The type whose values are made bytes, or with ``stored`` come from bytes; from or to others Spark casts."""
    if union or isinstance(kind, (T.NullType, T.BooleanType)):
        return kind
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType, f.metadata.get("letter"), bool(f.metadata.get("union")), stored), f.nullable, f.metadata) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType, letter, False, stored), kind.containsNull)
    letter, name = _letter(kind, letter), kind.simpleString()
    if stored and name == "binary":
        return kind
    if letter in scalars.INTEGERS:
        fits = {"smallint": "h", "int": "hiH", "bigint": "hiqHI", "decimal(20,0)": "Q"}
        return kind if letter in fits.get(name, "") else T.DecimalType(20, 0) if letter == "Q" else T.LongType()
    if letter in scalars.FLOATS:
        return T.DoubleType() if letter == "d" else T.FloatType()
    if letter not in ("s", "x"):
        raise ValueError(f"no format letter: {letter!r}")
    return T.StringType() if name == "string" or stored or letter == "x" else T.BinaryType()


def _same(a: T.DataType, b: T.DataType) -> bool:
    return a.simpleString() == b.simpleString()


def _encode(values: pa.Array, kind: T.DataType, letter: str | None) -> pa.Array:
    if isinstance(kind, T.BooleanType):
        return binary.of_numbers(values.fill_null(False).cast(pa.uint8()).to_numpy(), values)
    return binary.encode(values, _letter(kind, letter))


def _decode(values: pa.Array, kind: T.DataType, letter: str | None) -> pa.Array:
    if isinstance(kind, T.BooleanType):
        return pc.not_equal(values, pa.scalar(b"\0", values.type))
    if isinstance(kind, T.BinaryType):
        return values
    return binary.decode(values, _letter(kind, letter), to_arrow_type(kind))


#: Rows of a batch that is given to Spark.
BATCH = 1 << 16


def _cells(value: pa.Array, kind: T.DataType, start: int, letter: str | None, row: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Number, records, places and bytes of each column of the values of a type, in ascending number; ``row`` and ``pos`` say where these values are."""
    if isinstance(kind, T.StructType):
        at = start
        for f, part in zip(kind, value.flatten() if len(kind) else (), strict=True):
            if not f.metadata.get("union"):
                yield from _cells(part, f.dataType, at, f.metadata.get("letter"), row, pos)
            at += field_count(f.dataType)
    elif isinstance(kind, T.ArrayType):
        n = pc.list_value_length(value).fill_null(0).to_numpy().astype(np.int64)
        yield start, row, pos, binary.of_numbers(n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        below = np.column_stack([np.repeat(pos, n, axis=0), place.astype(np.int32)])
        yield from _cells(value.flatten(), kind.elementType, start + 1, letter, np.repeat(row, n), below)
    elif not isinstance(kind, T.NullType):
        yield start, row, pos, _encode(value, kind, letter)


def shred(df: DataFrame, record: str, key: str) -> DataFrame:
    """Streams of the records in column ``record``, told apart by ``key``.

    The cells of all list levels come from one pass over the records, without a shuffle, in order of
    record, column and place.  Null lists count as empty.  A missing struct's scalars are null.
    """
    kind = df.schema[record].dataType
    if not isinstance(kind, T.StructType):
        raise ValueError("a record is a struct")
    field_count(kind)
    plain = _plain(kind, None, False, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.arange(batch.num_rows)
            got = list(_cells(batch.column(1), plain, 0, None, row, np.zeros((len(row), 0), np.int32)))
            if not got or not len(row):
                continue
            rows = np.concatenate([r for _, r, _, _ in got])
            order = np.argsort(rows, kind="stable")
            ids = np.concatenate([np.full(len(r), i, np.int64) for i, r, _, _ in got])
            depth = np.concatenate([np.full(len(r), p.shape[1], np.int32) for _, r, p, _ in got])
            places = pa.ListArray.from_arrays(binary.offsets(depth), np.concatenate([p.reshape(-1) for _, _, p, _ in got]))
            v = pa.concat_arrays([v for _, _, _, v in got])
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                some = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at])), pa.array(ids[at]), places.take(some), v.take(some)], names=["key", "id", "pos", "v"])

    col = F.col(record) if _same(plain, kind) else F.col(record).cast(plain)
    out = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("id", T.LongType()), T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("v", T.BinaryType())])
    return df.select(F.col(key).alias("key"), col.alias("r")).mapInArrow(run, out)


PACK = T.StructType([T.StructField(x, T.BinaryType()) for x in ("ids", "depths", "places", "sizes", "data")])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of one key that follow each other as one row: numbers, depths, places, sizes (-1: null) and bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, id_, pos, v = batch.columns
        new = np.ones(n, bool)
        try:  # rows of one key that are not told as such merely make more rows
            new[1:] = ~pc.equal(key[1:], key[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        except pa.ArrowNotImplementedError:
            pass
        start = np.append(np.flatnonzero(new), n)
        depth = pc.list_value_length(pos).fill_null(0).to_numpy().astype(np.int32)
        size, data = binary.sizes_and_bytes(v)
        deep, far = np.concatenate([[0], np.cumsum(depth)]), np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
        parts = [(id_.to_numpy().astype(np.int64), start * 8), (depth, start * 4), (pos.flatten().to_numpy().astype(np.int32), deep[start] * 4), (size, start * 4), (data, far[start])]
        packed = [pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))]) for a, at in parts]
        yield pa.RecordBatch.from_arrays([key.take(pa.array(start[:-1])), *packed], names=["key", *PACK.names])


class _Columns:
    """The cells of a batch of records, column by column in order of record and place."""

    def __init__(self, packs: pa.ListArray):
        self.records = len(packs)
        n = pc.list_value_length(packs).fill_null(0).to_numpy()
        fields = dict(zip(PACK.names, packs.flatten().flatten(), strict=True))
        (size_i, ids), (_, depths), (_, places), (_, sizes), (_, data) = (binary.sizes_and_bytes(fields[x]) for x in PACK.names)
        self.ids, self.depths = ids.view("<i8"), depths.view("<i4")
        self.places = places.view("<i4")
        self.place_at = np.cumsum(self.depths) - self.depths
        sizes = sizes.view("<i4")
        self.rows = np.repeat(np.repeat(np.arange(self.records), n), size_i // 8)
        self.values = pa.Array.from_buffers(pa.binary(), len(sizes), [binary.validity(sizes >= 0), pa.py_buffer(binary.offsets(np.maximum(sizes, 0))), pa.py_buffer(data)])

    def column(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """How many cells each record has in a column, and the cells."""
        at = np.flatnonzero(self.ids == i)
        row = self.rows[at]
        deep = self.depths[at].max(initial=0)
        # A place that is cut short is before those that go on.
        keys = [np.where(k < self.depths[at], self.places[np.minimum(self.place_at[at] + k, len(self.places) - 1)], -1) for k in range(deep)]
        order = np.lexsort((*reversed(keys), row))
        return np.bincount(row, minlength=self.records), self.values.take(pa.array(at[order]))

    def level(self, kind: T.DataType, letter: str | None, start: int, places: np.ndarray) -> pa.Array:
        """All values of a type whose numbers begin at ``start``, in order of record and place; of the latter each record has so many."""
        total = int(places.sum())
        if isinstance(kind, T.StructType):
            at, parts = start, []
            for f in kind:
                union = bool(f.metadata.get("union"))
                parts.append(pa.nulls(total, to_arrow_type(f.dataType)) if union else self.level(f.dataType, f.metadata.get("letter"), at, places))
                at += field_count(f.dataType)
            names = [pa.field(f.name, a.type) for f, a in zip(kind, parts, strict=True)]
            return pa.StructArray.from_arrays(parts, fields=names) if parts else pa.array([{}] * total, pa.struct([]))
        if isinstance(kind, T.NullType):
            return pa.nulls(total)
        have, cells = self.column(start)
        if isinstance(kind, T.ArrayType):
            counted = binary.decode(cells, "Q", pa.int64()).fill_null(0).to_numpy()
            row = np.repeat(np.arange(self.records), have)
            below = np.bincount(row, counted, self.records).astype(np.int64)
            values = self.level(kind.elementType, letter, start + 1, below)
            lists = pa.ListArray.from_arrays(binary.offsets(counted), values)
            return lists if np.array_equal(have, places) else lists.take(self._of_places(have, places))
        if not np.array_equal(have, places):
            cells = cells.take(self._of_places(have, places))
        return _decode(cells, kind, letter)

    @staticmethod
    def _of_places(have: np.ndarray, places: np.ndarray) -> pa.Array:
        """Of each place the index of its cell, or null if the record has no more."""
        k = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
        return pa.array(np.repeat(np.cumsum(have) - have, places) + k, mask=k >= np.repeat(have, places))


def assemble(streams: DataFrame, kind: T.StructType) -> DataFrame:
    """Records (key, record) from their streams, which have a cell for each place as those of ``shred`` have.

    Cells of a key that follow each other become one row, and one shuffle brings a record's rows together.
    From the innermost lists outwards the values of a level are put together by their order, and parted
    by their lists' counts.
    """
    plain = _plain(kind, None, False, True)
    key = T.StructField("key", streams.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                record = _Columns(batch.column(1)).level(plain, None, 0, np.ones(batch.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), record], names=["key", "record"])

    packed = streams.select("key", "id", "pos", "v").mapInArrow(_packed, T.StructType([key, *PACK]))
    packs = packed.groupBy("key").agg(F.collect_list(F.struct(*PACK.names)).alias("packs"))
    records = packs.mapInArrow(run, T.StructType([key, T.StructField("record", plain)]))
    return records if _same(plain, kind) else records.select("key", F.col("record").cast(kind).alias("record"))
