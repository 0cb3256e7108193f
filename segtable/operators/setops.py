"""Bags of rows put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from segtable import model


def concat(*tables: DataFrame) -> DataFrame:
    """All rows of wide tables, repeated ones too; a column that a table lacks is null there."""
    got = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return got.select(*(model.name(i) for i in model.numbers(got)))


def append(df: DataFrame, path: str, **options: str) -> None:
    """Rows behind those of a Parquet table."""
    df.write.options(**options).mode("append").parquet(path)
