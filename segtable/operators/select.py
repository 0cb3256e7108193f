"""Selection: chosen columns of the rows that satisfy all predicates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segtable import model
from segtable.functions import scalars
from segtable.sources.segcol import read_segments

Cell = tuple[int, bytes | None]


class Select:
    """A query on a wide table.

        Select(df).select(0, 3).where(2, lambda c: c == b"x").run()

    Predicates are joined by AND.  They see nulls (an absent cell counts as null) and answer
    true or not: an unknown answer is no.

    ``letters`` makes it a query on typed columns: column N is the N-th name, its letter says how it
    is stored.  ``where_equals``, ``where_contains`` and ``where_value`` then compare the typed column
    itself, so that the scan can take the comparison over; only the result is encoded.
    """

    def __init__(self, df: DataFrame, strict: bool = False, letters: dict[str, str] | None = None):
        """``strict``: asking for a column that the table lacks is an error, else it is null."""
        self.df, self.strict = df, strict
        self.letters = letters or {}
        self.names = list(self.letters)
        self.ids: set[int] = set()
        self.tests: list[tuple[int, Column]] = []

    @classmethod
    def files(cls, spark: SparkSession, *paths: str, strict: bool = False) -> Select:
        """A query on segment files that fetches only the columns it names, filters' columns first."""
        return _FileSelect(spark, paths, strict)

    def _has(self, i: int) -> bool:
        return i < len(self.names) if self.letters else model.name(i) in self.df.columns

    def _value(self, i: int) -> Column:
        """The column itself, typed if the query has letters."""
        if not self._has(i):
            if self.strict:
                raise KeyError(f"no column {i}")
            return F.lit(None).cast("binary")
        return F.col(f"`{self.names[i]}`") if self.letters else F.col(model.name(i))

    def _cell(self, i: int) -> Column:
        """The stored bytes."""
        value = self._value(i)
        return scalars.encode(value, self.letters[self.names[i]]) if self.letters and self._has(i) else value

    def _text(self, i: int, pattern: bytes) -> str | None:
        """The pattern as text where the column is text and the pattern can be text."""
        if not self.letters or not self._has(i) or self.df.schema[self.names[i]].dataType.simpleString() != "string":
            return None
        try:
            return pattern.decode()
        except UnicodeDecodeError:
            return None

    def select(self, *ids: int) -> Select:
        """Add columns; naming one twice is the same as once."""
        self.ids |= set(ids)
        return self

    def where(self, i: int, test: Callable[[Column], Column]) -> Select:
        """Add a predicate as an expression of the stored cell, which stays in the JVM."""
        self.tests.append((i, test(self._cell(i))))  # a filter takes an unknown answer for no
        return self

    def where_value(self, i: int, test: Callable[[Column], Column]) -> Select:
        """Add a predicate as an expression of the typed column, which can be pushed to the scan."""
        self.tests.append((i, test(self._value(i))))
        return self

    def where_equals(self, i: int, value: bytes | str) -> Select:
        """The cell is these bytes.  A null never is."""
        value = value.encode() if isinstance(value, str) else value
        text = self._text(i, value)
        return self.where(i, lambda c: c == F.lit(value)) if text is None else self.where_value(i, lambda c: c == F.lit(text))

    def where_contains(self, i: int, pattern: bytes | str) -> Select:
        """The cell holds these bytes.  A null never does."""
        pattern = pattern.encode() if isinstance(pattern, str) else pattern
        text = self._text(i, pattern)
        return self.where(i, lambda c: F.contains(c, F.lit(pattern))) if text is None else self.where_value(i, lambda c: F.contains(c, F.lit(text)))

    def where_call(self, i: int, test: Callable[[bytes | None], bool]) -> Select:
        """Add a predicate as a Python function of bytes or None; it is called once per distinct value of a batch."""

        def run(values: pd.Series) -> pd.Series:
            known: dict[bytes | None, bool] = {}
            out = []
            for v in values:
                v = None if v is None else bytes(v)
                if v not in known:
                    known[v] = bool(test(v))
                out.append(known[v])
            return pd.Series(out, dtype=bool)

        self.tests.append((i, F.pandas_udf(run, "boolean")(self._cell(i))))
        return self

    def _every(self) -> list[int]:
        return list(range(len(self.names))) if self.letters else model.numbers(self.df)

    def run(self) -> DataFrame:
        """The result, columns ascending.

        Without any selected column: all of them if there is no predicate, else none, one empty
        row per match.
        """
        df = self.df
        for _, test in sorted(self.tests, key=lambda t: t[0]):
            df = df.filter(test)
        if not self.ids:
            if self.tests:
                return df.select()
            if not self.letters:
                return df
        ids = sorted(self.ids) or self._every()
        return df.select(*(self._cell(i).alias(model.name(i), metadata={"id": i}) for i in ids))

    def rows(self) -> Iterator[list[Cell]]:
        """The result's rows one by one, on the driver, a partition at a time."""
        got = self.run()
        ids = model.numbers(got)
        for row in got.toLocalIterator():
            yield [(i, None if v is None else bytes(v)) for i, v in zip(ids, (row[model.name(i)] for i in ids), strict=True)]

    def cursor(self) -> Cursor:
        """The result's rows with a look at the next one and a way back to the start, on the driver."""
        return Cursor(self)

    def execute(self, call: Callable[[Iterable[Cell]], None]) -> None:
        """Call a function with each row, where the row is."""
        got = self.run()
        ids = model.numbers(got)

        def each(rows) -> None:
            for row in rows:
                call([(i, None if row[model.name(i)] is None else bytes(row[model.name(i)])) for i in ids])

        got.foreachPartition(each)


class Cursor:
    """Rows one after another: ``peek`` looks without moving on, ``rewind`` starts afresh, ``offset`` counts."""

    def __init__(self, query: Select):
        self.query = query
        self.rewind()

    def rewind(self) -> None:
        """Back to the first row: the plan runs again."""
        self.offset, self._rows, self._next = 0, self.query.rows(), []

    def peek(self) -> list[Cell] | None:
        """The row that ``next`` would give; None at the end."""
        if not self._next:
            self._next = [next(self._rows, None)]
        return self._next[0]

    @property
    def end(self) -> bool:
        return self.peek() is None

    def __iter__(self) -> Cursor:
        return self

    def __next__(self) -> list[Cell]:
        row = self.peek()
        if row is None:
            raise StopIteration
        self._next = []
        self.offset += 1
        return row


class _FileSelect(Select):
    """A query on segment files: the scan is made when all its columns are known."""

    def __init__(self, spark: SparkSession, paths: Sequence[str], strict: bool):
        self.spark, self.paths, self.strict = spark, paths, strict
        self.letters, self.names = {}, []
        self.ids, self.tests = set(), []
        self.pushed: list[tuple[int, str, bytes | None]] = []
        self._df: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            named = self.ids | {i for i, _ in self.tests}
            # A test alone needs its column; without both every column counts.
            self._df = read_segments(self.spark, *self.paths, columns=named or None, strict=self.strict, tests=self.pushed)
        return self._df

    def _has(self, i: int) -> bool:
        return True

    def _every(self) -> list[int]:
        return model.numbers(self.df)

    def where_equals(self, i: int, value: bytes | str) -> Select:
        self.pushed.append((i, "=", value.encode() if isinstance(value, str) else value))
        return super().where_equals(i, value)

    def where_contains(self, i: int, pattern: bytes | str) -> Select:
        self.pushed.append((i, "in", pattern.encode() if isinstance(pattern, str) else pattern))
        return super().where_contains(i, pattern)

    def run(self) -> DataFrame:
        self._df = None
        return super().run()
