"""Rows in order of all their cells, and their places in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtable import model
from segtable.shared import shared_path

from .setops import concat


def sort_rows(df: DataFrame) -> DataFrame:
    """A wide table by its columns in ascending number: null first, then unsigned bytes."""
    return df.orderBy(*(F.col(model.name(i)).asc_nulls_first() for i in model.numbers(df)))


def sort_exact(df: DataFrame) -> DataFrame:
    """An exact table by its rows of (id, v).

    Where one row has a cell and the other's next is a later column, the present one is first; a
    row that is the start of another is before it; a null is before any value.
    """
    return df.orderBy(F.col("row").asc_nulls_first())


def merge(*tables: DataFrame) -> DataFrame:
    """Tables that are sorted already as one sorted table.  Their order is not relied upon."""
    return sort_rows(concat(*tables))


def with_ordinals(df: DataFrame, column: str = "ordinal") -> DataFrame:
    """A sorted DataFrame with each row's place, from 1.

    Rows are numbered within partitions and written once to the shared folder, so that the sort is not
    run again; one count per partition goes to the driver and back.  No window runs over the whole table.
    """
    spark = df.sparkSession
    path = shared_path(spark, "ordered")
    # Partitions of a sorted table follow each other; the lower 33 bits number their rows.
    df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    place = spark.read.schema(df.schema.add("_at", "long")).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = {r["_part"]: r["count"] for r in place.groupBy("_part").count().collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    start = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))  # a row for each partition
    ordinal = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return place.join(start, "_part").select(*df.columns, ordinal.alias(column))


def is_sorted(df: DataFrame) -> DataFrame:
    """One row per partition of a wide table: its number of rows, and whether they are in order."""
    ids = model.numbers(df)

    def run(batches):
        import pyarrow as pa

        last, n, good = None, 0, True
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple((v is not None, v or b"") for v in row)
                good &= last is None or last <= key
                last, n = key, n + 1
        yield pa.RecordBatch.from_pydict({"n": [n], "sorted": [good]})

    return df.select(*(model.name(i) for i in ids)).mapInArrow(run, T.StructType([T.StructField("n", T.LongType()), T.StructField("sorted", T.BooleanType())]))
