"""What run and prefix coding would make of a column, as window queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed by the segment format: a prefix is taken over from 3 bytes on, up to 64.
LEAST_PREFIX, MOST_PREFIX = 3, 64


def run_numbers(df: DataFrame, value: str, segment: list[str], order: list[str], name: str = "run") -> DataFrame:
    """The run (from 1) that each row's value falls into, within its segment; nulls next to each other are one.

    Rows are numbered once, so that rows which are equal in ``order`` have one order throughout.
    """
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*segment).orderBy(*order)))
    w = Window.partitionBy(*segment).orderBy("_n")
    new = F.when(F.col("_n") == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_n")


def runs(df: DataFrame, value: str, segment: list[str], order: list[str]) -> DataFrame:
    """One row per run: segment, run, value, how often."""
    return run_numbers(df, value, segment, order).groupBy(*segment, "run").agg(F.first(value).alias("value"), F.count("*").alias("n"))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many bytes two values share at their start, at most 64."""
    most = F.least(F.octet_length(a), F.octet_length(b), F.lit(MOST_PREFIX))
    steps = F.filter(F.sequence(F.lit(1), F.lit(MOST_PREFIX)), lambda n: (n <= most) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))
    return F.size(steps)


def prefix_lengths(df: DataFrame, value: str, segment: list[str], order: list[str], name: str = "prefix") -> DataFrame:
    """How many bytes of each value prefix coding takes over from the value before (0: none); null for nulls."""
    w = Window.partitionBy(*segment).orderBy(*order)
    before = F.lag(F.col(value).cast("binary")).over(w)
    shared = F.coalesce(shared_prefix(F.col(value).cast("binary"), before), F.lit(0))
    coded = F.when(shared >= LEAST_PREFIX, shared).otherwise(0)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), coded))
