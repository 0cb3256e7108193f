"""The data model: columns with numbers, cells that are a value, null or absent.

*Wide* tables have one nullable binary column ``c<N>`` for each column number N; absent cells
are null.  *Exact* tables have one column ``row``, an array of (id, v) in ascending id, in which an
absent cell has no entry, so that it differs from a null one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.BinaryType())])
EXACT = T.StructType([T.StructField("row", T.ArrayType(CELL, False))])


def name(number: int) -> str:
    """The field name of a column number."""
    if not 0 <= number < 1 << 32:
        raise ValueError(f"a column number is an unsigned 32-bit integer, not {number}")
    return f"c{number}"


def number_of(field: str) -> int | None:
    """The column number of a field name, or None if it isn't one."""
    m = re.fullmatch(r"c(0|[1-9][0-9]*)", field)
    return int(m[1]) if m and int(m[1]) < 1 << 32 else None


def numbers(df: DataFrame) -> list[int]:
    """The column numbers of a wide table, ascending."""
    return sorted(n for c in df.columns if (n := number_of(c)) is not None)


def wide_schema(ids: Iterable[int]) -> T.StructType:
    return T.StructType([T.StructField(name(i), T.BinaryType(), True, {"id": i}) for i in sorted(set(ids))])


def to_bytes(col: Column) -> Column:
    """Text as its UTF-8 bytes; bytes as they are."""
    return col.cast("binary")


def numbered(df: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """The columns of ``df``, which are text or bytes, as a wide table; numbered by place unless ``ids`` says."""
    ids = range(len(df.columns)) if ids is None else ids
    pairs = sorted(zip(ids, df.columns, strict=True))
    return df.select(*(to_bytes(F.col(f"`{c}`")).alias(name(i), metadata={"id": i, "name": c}) for i, c in pairs))


def named(df: DataFrame, names: dict[int, str], text: bool = True) -> DataFrame:
    """Chosen columns of a wide table under names, as text or as bytes."""
    return df.select(*((F.col(name(i)).cast("string") if text else F.col(name(i))).alias(n) for i, n in names.items()))


def to_exact(df: DataFrame, null_is_absent: bool = False) -> DataFrame:
    """A wide table as an exact one; nulls are null cells, or absent ones."""
    cells = [F.struct(F.lit(i).cast("long").alias("id"), F.col(name(i)).alias("v")) for i in numbers(df)]
    row = F.array(*cells).cast(T.ArrayType(CELL)) if cells else F.array().cast(T.ArrayType(CELL))
    return df.select((F.filter(row, lambda x: x["v"].isNotNull()) if null_is_absent else row).alias("row"))


def cell(row: Column, i: int) -> Column:
    """The value of column ``i`` in an exact row; null if absent."""
    return F.get(F.filter(row, lambda x: x["id"] == i), 0)["v"]


def from_exact(df: DataFrame, ids: Iterable[int]) -> DataFrame:
    """An exact table as a wide one of these columns; absent cells become null."""
    return df.select(*(cell(F.col("row"), i).alias(name(i), metadata={"id": i}) for i in sorted(set(ids))))
