"""A stream over segment files that grow: new files, and segments appended to old ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from segtable.sources import codec, files
from segtable.sources.segcol import _Part, _paths, _Reader


class SegmentStream(D.DataSourceStreamReader):
    """Offsets are bytes per file.  A segment belongs to one batch, as soon as it is whole."""

    def __init__(self, options, schema: T.StructType):
        self.paths, self.reader = _paths(options), _Reader(options, schema)
        self._seen: dict[str, int] = {}  # whole segments so far, so that a trigger reads new headers only

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for top in self.paths:
            for path in files.listed(top):
                with files.open_read(path) as f:
                    size = f.seek(0, 2)
                    if size < len(codec.MAGIC):
                        continue
                    codec.check_magic(f)
                    at = self._seen.get(path, len(codec.MAGIC))
                    try:
                        while (s := codec.header(f, at)) is not None and s.end <= size:
                            at = s.end
                    except codec.SegmentError:
                        pass  # a header that is still being written
                    out[path] = self._seen[path] = at
        return out

    def partitions(self, start: dict, end: dict) -> list[D.InputPartition]:
        at = {path: int(start.get(path, len(codec.MAGIC))) for path in end}
        return [_Part(path, at[path], int(stop), True) for path, stop in sorted(end.items()) if at[path] < int(stop)]

    def read(self, partition: D.InputPartition) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)
