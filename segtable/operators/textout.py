"""Rows as lines of text, their cells parted by tabs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtable import model
from segtable.functions import scalars

from .select import Select

LETTERS = "HIQhiqdfsx_"


def _general(values: pd.Series) -> pd.Series:
    """Six significant digits, as C++ streams print floating-point numbers."""
    return values.map(lambda v: None if pd.isna(v) and v != v and v is None else "%g" % v)


def printed(col: Column, letter: str) -> Column:
    """A cell's text by the letter of its format; a null is empty, ``_`` is left out."""
    if letter not in LETTERS or letter == "_":
        raise ValueError(f"no format letter: {letter!r}")
    value = scalars.decode(col, letter)
    if letter in "df":
        value = F.when(col.isNotNull(), F.pandas_udf(_general, "string")(F.coalesce(value.cast("double"), F.lit(0.0))))
    return F.coalesce(value.cast("string"), F.lit(""))


def render(df: DataFrame, formats: str = "", name: str = "line") -> DataFrame:
    """A wide table as one column of lines.

    ``formats`` has a letter for each column number; columns beyond its end, and ``_``, are left
    out.  Without formats every column is text.  A number that no column has prints as empty.
    """
    ids = model.numbers(df)
    every = range(len(formats)) if formats else range(ids[-1] + 1 if ids else 0)
    cells = []
    for i in every:
        letter = formats[i] if formats else "s"
        if letter != "_":
            cells.append(printed(F.col(model.name(i)), letter) if i in ids else F.lit(""))
    return df.select((F.concat_ws("\t", *cells) if cells else F.lit("")).alias(name))


def print_rows(df: DataFrame, formats: str = "", filters: Sequence[tuple[int, bytes | str]] = (), name: str = "line") -> DataFrame:
    """Lines of the rows whose cells hold all the patterns.

    Several patterns on one column must all be there.  With filters but no formats, only the
    filters' columns are printed, the others' places stay empty.
    """
    q = Select(df)
    for i, pattern in filters:
        q.where_contains(i, pattern)
    ids = [i for i, x in enumerate(formats) if x != "_"] if formats else sorted({i for i, _ in filters})
    if not ids and not formats:
        return render(q.run(), "", name)
    return render(q.select(*ids).run(), formats, name)


def parse_filter(text: str) -> tuple[int, str]:
    """A filter COLUMN:PATTERN; the first colon parts them."""
    column, colon, pattern = text.partition(":")
    if not colon:
        raise ValueError(f"a filter is COLUMN:PATTERN, not {text!r}")
    return int(column), pattern


def write_text(df: DataFrame, path: str, formats: str = "", mode: str = "errorifexists") -> None:
    """Lines as text files, without quoting."""
    render(df, formats, "value").write.mode(mode).text(path)
