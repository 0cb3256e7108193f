"""What is done with whole files: print, put together, recompress, sort, merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from segtable import model
from segtable.sources.codec import DEFAULT
from segtable.sources.segcol import read_segments, write_segments

from . import ordering, textout
from .select import Select


def show(spark: SparkSession, paths: Sequence[str], formats: str = "", filters: Sequence[str] = ()) -> DataFrame:
    """Files as lines of text; ``filters`` are COLUMN:PATTERN.  Only the columns concerned are read."""
    parsed = [textout.parse_filter(f) for f in filters]
    ids = {i for i, x in enumerate(formats) if x != "_"} | {i for i, _ in parsed}
    return textout.print_rows(read_segments(spark, *paths, columns=ids or None), formats, parsed)


def rewrite(spark: SparkSession, paths: Sequence[str], out: str, compression: str = DEFAULT, filters: Sequence[str] = (), mode: str = "append") -> None:
    """Files put together as one table, in another compression; filters are honoured."""
    q = Select(read_segments(spark, *paths))
    for f in filters:
        q.where_contains(*textout.parse_filter(f))
    write_segments(q.select(*model.numbers(q.df)).run(), out, compression, mode)


def sort(spark: SparkSession, paths: Sequence[str], out: str, mode: str = "append") -> None:
    """The rows of all files in order; presorted files need no other treatment."""
    write_segments(ordering.sort_rows(read_segments(spark, *paths)), out, mode=mode)
