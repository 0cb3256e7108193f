"""The data source ``segcol``: segment files as DataFrames, read and written without the driver.

    spark.dataSource.register(SegcolSource)
    spark.read.format("segcol").option("columns", "0,3").load(path)
    df.write.format("segcol").option("compression", "zlib").mode("append").save(path)

Options: ``columns`` (numbers, by comma: only these are read), ``mode`` (``wide``: a column c<N> for
each number; ``exact``: one column ``row``), ``strict`` (true: a segment that has none of the asked
columns is an error, else they are null), ``tests`` (filters, see below), ``compression``, ``segment_bytes``.

One partition of a read is a file, or a range of ``SPLIT`` bytes of a larger one; segments belong to
the range in which they start, and headers are read in the tasks.  Only the asked columns' bytes are
fetched.  Filters on cells are tried on the filters' columns first, run by run; the other
columns are fetched only if a row is left.  Without ``columns`` the driver reads every header once for
the schema, so name the columns of large tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from io import BytesIO
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from segtable import model
from segtable.errors import SegmentError

from . import codec, files

#: Bytes of a file that one task reads.
SPLIT = 256 << 20
#: A table of fewer ranges than the session has cores is cut into as many, but not into smaller ones than this.
LEAST_SPLIT = 4 << 20
#: Rows of a batch that is given to Spark.
ROWS = 1 << 16
ARROW_CELL = pa.struct([pa.field("id", pa.int64(), False), pa.field("v", pa.binary())])


def _paths(options) -> list[str]:
    if "paths" in options:
        return json.loads(options["paths"])
    if "path" not in options:
        raise ValueError("segcol: a path is missing")
    return [options["path"]]


def _wanted(options) -> list[int] | None:
    text = options.get("columns", "")
    if text.strip() == "-":  # no column, rows only
        return []
    return sorted({int(x) for x in text.split(",")}) if text.strip() else None


def padded(columns: dict[int, pa.Array], ids: Iterable[int], rows: int) -> list[pa.Array]:
    """Columns of one length; what a segment lacks is null."""
    out = []
    for i in ids:
        a = columns.get(i)
        a = pa.nulls(rows, pa.binary()) if a is None else a
        out.append(a if len(a) == rows else pa.concat_arrays([a, pa.nulls(rows - len(a), pa.binary())]))
    return out


def exact_rows(columns: dict[int, pa.Array]) -> pa.Array:
    """Rows of (id, v); a column that has run out has no cell."""
    ids = sorted(columns)
    rows = max((len(columns[i]) for i in ids), default=0)
    size = np.array([len(columns[i]) for i in ids], np.int64)
    have = np.arange(rows)[:, None] < size[None, :]
    per_row = have.sum(1)
    row, col = np.nonzero(have)
    start = np.concatenate([[0], np.cumsum(size)])
    values = pa.concat_arrays([columns[i] for i in ids]) if ids else pa.array([], pa.binary())
    cells = pa.StructArray.from_arrays([pa.array(np.array(ids, np.int64)[col]), values.take(pa.array(start[col] + row))], fields=list(ARROW_CELL))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), cells, type=pa.list_(pa.field("element", ARROW_CELL, False)))


def columns_of(rows: pa.ListArray) -> dict[int, pa.Array] | None:
    """The columns of rows of (id, v), as ``SegmentWriter.put_row`` puts them: what is missing in between is null, and
    rows without a cell leave nothing.  None if a row has one column twice."""
    n = pc.list_value_length(rows).fill_null(0).to_numpy()
    cells = rows.flatten()
    ids, values = cells.field(0).to_numpy(), cells.field(1)
    row = np.repeat(np.cumsum(n > 0) - 1, n)
    out = {}
    for i in np.unique(ids).tolist():
        at = np.flatnonzero(ids == i)
        where = row[at]
        if len(where) > 1 and (np.diff(where) == 0).any():
            return None
        source, none = np.zeros(where[-1] + 1, np.int64), np.ones(where[-1] + 1, bool)
        source[where], none[where] = at, False
        out[i] = values.take(pa.array(source, mask=none if none.any() else None))
    return out


@dataclass
class _Part(D.InputPartition):
    """A file's segments that start at a place or behind it, but before its end.

    ``known``: a segment starts right there.
    """

    path: str
    start: int
    end: int
    known: bool = False


class _Test:
    """A filter on one column's value: = (also of nulls: <=>), in a set, holding bytes, being null; or its contrary."""

    def __init__(self, column: int, kind: str, value, negate: bool = False):
        self.column, self.kind, self.value, self.negate = column, kind, value, negate

    @classmethod
    def pushed(cls, f: D.Filter) -> _Test | None:
        """What Spark pushes down, as far as it can be tried on runs."""
        negate = isinstance(f, D.Not)
        f = f.child if negate else f
        kinds = {D.EqualTo: "=", D.EqualNullSafe: "<=>", D.In: "set", D.IsNull: "null", D.IsNotNull: "value"}
        if type(f) not in kinds or len(f.attribute) != 1 or (i := model.number_of(f.attribute[0])) is None:
            return None
        return cls(i, kinds[type(f)], getattr(f, "value", None), negate)

    def of(self, v: bytes | None) -> bool:
        if self.kind in ("null", "value"):
            return ((v is None) == (self.kind == "null")) != self.negate
        if self.kind == "<=>":
            return (v == self.value) != self.negate
        if v is None:
            return False
        return (v in self.value if self.kind == "set" else self.value in v if self.kind == "in" else v == self.value) != self.negate


def headers(path: str, start: int = len(codec.MAGIC), end: int | None = None) -> list[codec.Segment]:
    """The segments of a file that start in a range; those before it are stepped over."""
    with files.open_read(path) as f:
        return [s for at, s in codec.segments(f, None, end) if at >= start]


class _Reader(D.DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.paths, self.wanted = _paths(options), _wanted(options)
        self.exact = options.get("mode", "wide") == "exact"
        self.cores = int(options.get("cores", "0"))
        self.strict = options.get("strict", "false").lower() == "true"
        self.ids = self.wanted if self.exact else [i for f in schema if (i := model.number_of(f.name)) is not None]
        self.given = [] if self.exact else [_Test(i, kind, bytes.fromhex(v)) for i, kind, v in json.loads(options.get("tests", "[]"))]
        self.tests = self.given

    def partitions(self) -> list[D.InputPartition]:
        out, found = [], [x for top in self.paths for x in files.sized(top)]
        split = min(SPLIT, max(LEAST_SPLIT, sum(size for _, size in found) // self.cores + 1)) if self.cores else SPLIT
        for path, size in found:
            first = len(codec.MAGIC)
            cuts = [first, *range(split, size, split), max(size, first + 1)]
            out += [_Part(path, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's task for a table without partitions
            return
        with files.open_read(partition.path) as f:
            for at, segment in codec.segments(f, partition.start if partition.known else None, partition.end):
                if at < partition.start:
                    continue
                have = {i for i, _, _ in segment.columns}
                if self.strict and self.ids and not have & set(self.ids):
                    raise SegmentError("a segment has none of the asked columns")
                yield from self._batches(f, segment)

    def _batches(self, f, segment: codec.Segment) -> Iterator[pa.RecordBatch]:
        if self.exact:
            columns = codec.read_segment(f, segment, self.ids)
            for k in range(0, max(map(len, columns.values()), default=0), ROWS):
                yield pa.RecordBatch.from_arrays([exact_rows({i: a[k : k + ROWS] for i, a in columns.items()})], names=["row"])
            return
        stay = None
        for test in self.tests:
            data = segment.read(f, test.column)
            got = list(codec.runs(data)) if data is not None else []
            good = np.repeat(np.array([test.of(v) for _, v in got], bool), np.array([n for n, _ in got], np.int64)) if got else np.zeros(0, bool)
            if stay is not None and len(stay) != len(good):
                more = max(len(stay), len(good))
                rest = test.of(None)
                good = np.concatenate([good, np.full(more - len(good), rest)])
                stay = np.concatenate([stay, np.ones(more - len(stay), bool)])
            stay = good if stay is None else stay & good
            if not stay.any() and not any(t.of(None) for t in self.tests):
                return
        if not self.ids:  # rows are counted by the lengths of runs, no value is made
            rows = max((codec.count_values(segment.read(f, i)) for i, _, _ in segment.columns), default=0)
            for k in range(0, rows, ROWS):
                yield pa.RecordBatch.from_struct_array(pa.array([{}] * min(ROWS, rows - k), pa.struct([])))
            return
        # Rows are counted by the asked columns and the segment's first: headers hold no counts, and
        # what this source writes has columns of one length.
        columns = codec.read_segment(f, segment, {*self.ids, segment.columns[0][0]} if segment.columns else None)
        rows = max(map(len, columns.values()), default=0)
        names = [model.name(i) for i in self.ids]
        for k in range(0, rows, ROWS):
            some = {i: a[k : k + ROWS] for i, a in columns.items()}
            yield pa.RecordBatch.from_arrays(padded(some, self.ids, min(ROWS, rows - k)), names=names)


class _FilteringReader(_Reader):
    """With ``push``, which the session must allow by spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Those that can be tried on runs spare fetching segments; Spark applies all of them again."""
        self.tests = self.given + ([] if self.exact else [t for f in filters if (t := _Test.pushed(f)) is not None])
        yield from filters


class _Writer(D.DataSourceArrowWriter):
    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = _paths(options)[0], overwrite
        self.compression = options.get("compression", codec.DEFAULT)
        codec.compression(self.compression)
        self.segment_bytes = int(options.get("segment_bytes", codec.SEGMENT_BYTES))
        self.exact = [f.name for f in schema] == ["row"] and isinstance(schema["row"].dataType, T.ArrayType)
        self.ids = [] if self.exact else [self._id(f) for f in schema]

    @staticmethod
    def _id(field: T.StructField) -> int:
        i = model.number_of(field.name)
        if i is None or not isinstance(field.dataType, T.BinaryType):
            raise ValueError(f"segcol writes binary columns c<N>, or one column row; not {field.name} {field.dataType.simpleString()}")
        return i

    def write(self, iterator: Iterator[pa.RecordBatch]) -> D.WriterCommitMessage:
        """One file of a task's rows, written segment by segment; none if there are no rows."""
        path = f"{self.path.rstrip('/')}/part-{uuid.uuid4().hex}.seg"
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return _Written("")
        held: list[pa.RecordBatch] = []
        size = 0
        with files.open_new(path) as f:
            w = codec.SegmentWriter(f, self.compression, True, self.segment_bytes)

            def flush() -> None:
                nonlocal held, size
                if held:
                    table = pa.Table.from_batches(held)
                    if self.exact:
                        rows = table.column(0).combine_chunks()
                        columns = columns_of(rows)
                        if columns is None:
                            for row in rows.to_pylist():
                                w.put_row((c["id"], c["v"]) for c in row)
                            w.flush()
                        else:
                            w.put_columns(columns)
                    else:
                        w.put_columns({i: table.column(k) for k, i in enumerate(self.ids)})
                    held, size = [], 0

            for batch in chain([first], iterator):
                if size > self.segment_bytes:
                    flush()
                held.append(batch)
                size += batch.nbytes
            flush()
            w.finish()
        return _Written(path)

    def commit(self, messages) -> None:
        """With overwrite, what was there before goes once all parts are written."""
        new = {m.path for m in messages if m is not None and m.path}
        if self.overwrite:
            base = {p.rsplit("/", 1)[-1] for p in new}
            for old in files.listed(self.path) if new else []:
                if old.rsplit("/", 1)[-1] not in base:
                    files.remove(old)
        if not new:
            # An empty table is its mark.
            files.write_new(f"{self.path.rstrip('/')}/part-{uuid.uuid4().hex}.seg", codec.MAGIC)
        files.write_new(f"{self.path.rstrip('/')}/_SUCCESS", b"")

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.path:
                files.remove(m.path)


@dataclass
class _Written(D.WriterCommitMessage):
    path: str


class SegcolSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "segcol"

    def schema(self) -> T.StructType:
        if self.options.get("mode", "wide") == "exact":
            return model.EXACT
        wanted = _wanted(self.options)
        if wanted is not None:
            return model.wide_schema(wanted)
        every = [path for top in _paths(self.options) for path in files.listed(top)]
        with ThreadPoolExecutor(32) as pool:
            found = pool.map(lambda path: {i for s in headers(path) for i, _, _ in s.columns}, every)
            return model.wide_schema(set().union(*found))

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        push = self.options.get("push", "false").lower() == "true"  # Spark refuses sources that take filters unless the session allows it
        return (_FilteringReader if push else _Reader)(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> D.DataSourceWriter:
        return _Writer(self.options, schema, overwrite)

    def streamReader(self, schema: T.StructType) -> D.DataSourceStreamReader:
        from segtable.streaming.segments import SegmentStream

        return SegmentStream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make ``segcol`` known to the session; filters are pushed to it if the session allows."""
    spark.dataSource.register(SegcolSource)


def read_segments(spark: SparkSession, *paths: str, columns: Iterable[int] | None = None, mode: str = "wide", strict: bool = False, tests: Sequence[tuple[int, str, bytes]] = ()) -> DataFrame:
    """One or more tables of segment files, in the order given.

    ``tests``: (column, "=" or "in", bytes).  They spare segments that have no such row; others'
    rows come whole, so the caller filters again.
    """
    register(spark)
    reader = spark.read.format("segcol").option("paths", json.dumps(list(paths))).option("mode", mode).option("strict", str(strict).lower()).option("cores", str(spark.sparkContext.defaultParallelism))
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        reader = reader.option("push", "true")
    if tests:
        reader = reader.option("tests", json.dumps([(i, kind, v.hex()) for i, kind, v in tests]))
    if columns is not None:
        reader = reader.option("columns", ",".join(map(str, sorted(set(columns)))) or "-")
    return reader.load()


def write_segments(df: DataFrame, path: str, compression: str = codec.DEFAULT, mode: str = "append", segment_bytes: int = codec.SEGMENT_BYTES) -> None:
    """A wide or exact table as segment files; ``append`` adds to what is there."""
    codec.compression(compression)
    register(df.sparkSession)
    df.write.format("segcol").option("compression", compression).option("segment_bytes", str(segment_bytes)).mode(mode).save(path)


def read_store(spark: SparkSession, path: str, columns: Iterable[int]) -> DataFrame:
    """Segment files in a store that only Spark's own readers open: one task per file."""
    ids = sorted(set(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                f = BytesIO(data.as_py())
                for _, s in codec.segments(f):
                    got = codec.read_segment(f, s)
                    rows = max(map(len, got.values()), default=0)
                    yield pa.RecordBatch.from_arrays(padded(got, ids, rows), names=[model.name(i) for i in ids])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.seg").load(path).select("content")
    return found.mapInArrow(run, model.wide_schema(ids))

