"""The test tables as numbered byte columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segtable import model
from segtable.functions import scalars


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stamp(col: str) -> Column:
    """A timestamp as ISO text."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def as_bytes(df: DataFrame, letters: dict[str, str]) -> DataFrame:
    """Columns as a wide table, numbered in the order given; each by the letter of its format."""
    cols = [scalars.encode(F.col(c), x).alias(model.name(i), metadata={"id": i}) for i, (c, x) in enumerate(letters.items())]
    return df.select(*cols)


def as_values(df: DataFrame, letters: dict[str, str], only: list[str] | None = None) -> DataFrame:
    """The way back."""
    return df.select(*(scalars.decode(F.col(model.name(i)), x).alias(c) for i, (c, x) in enumerate(letters.items()) if only is None or c in only))


SUPPLIER = {"s_suppkey": "q", "s_name": "s", "s_nationkey": "i", "s_acctbal": "d"}
ORDERS = {"o_orderkey": "q", "o_custkey": "q", "o_orderstatus": "s", "o_totalprice": "d", "o_orderpriority": "s"}
PART = {"p_partkey": "q", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "d"}
