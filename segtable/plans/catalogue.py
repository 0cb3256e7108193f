"""The registered queries, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import json
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtable import model
from segtable.functions import scalars
from segtable.operators import encode_stats, nested, ordering, setops, textout, tools
from segtable.operators.select import Select
from segtable.shared import shared_path
from segtable.sources import codec
from segtable.sources.segcol import read_segments, read_store, write_segments

from .tables import ORDERS, PART, SUPPLIER, as_bytes, as_values, load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _wide(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """Text columns, and others as their text, as a wide table."""
    df = load(spark, sf_dir, table)
    return model.numbered(df.select(*(F.col(c).cast("string").alias(c) for c in cols)))


def _text(df: DataFrame, **names: int) -> DataFrame:
    return model.named(df, {i: n for n, i in names.items()})


# Projection and predicates.


@query("SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def scan_project(spark, sf_dir):
    got = Select(_wide(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")).select(3, 1, 2).run()
    return _text(got, l_returnflag=1, l_linestatus=2, l_linenumber=3).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_all_columns(spark, sf_dir):
    letters = {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"}
    return as_values(Select(as_bytes(load(spark, sf_dir, "nation"), letters)).run(), letters)


@query("SELECT r_name, r_regionkey FROM region")
def select_dedup_ids(spark, sf_dir):
    letters = {"r_regionkey": "i", "r_name": "s"}
    return as_values(Select(as_bytes(load(spark, sf_dir, "region"), letters)).select(1, 0, 1).select(0).run(), letters)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_bytes_eq(spark, sf_dir):
    letters = {"o_orderkey": "q", "o_orderstatus": "s"}
    return as_values(Select(load(spark, sf_dir, "orders"), letters=letters).select(0, 1).where_equals(1, b"F").run(), letters)


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ing')")
def filter_contains(spark, sf_dir):
    letters = {"p_partkey": "q", "p_name": "s"}
    return as_values(Select(load(spark, sf_dir, "part"), letters=letters).select(0, 1).where_contains(1, "ing").run(), letters)


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'd') AND contains(p_name, 'ring')")
def filter_same_column_and(spark, sf_dir):
    letters = {"p_partkey": "q", "p_name": "s"}
    return as_values(Select(load(spark, sf_dir, "part"), letters=letters).select(0, 1).where_contains(1, "d").where_contains(1, "ring").run(), letters)


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem WHERE contains(l_returnflag, 'R') AND l_linestatus = 'F'")
def filter_multi_column_and(spark, sf_dir):
    """The flagship: two predicates on columns that are not in the result."""
    letters = {"l_orderkey": "q", "l_linenumber": "i", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "s"}
    df = load(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    got = Select(df, letters=letters).select(0, 1, 4).where_contains(2, "R").where_equals(3, "F").run()
    return as_values(got, letters, ["l_orderkey", "l_linenumber", "l_shipdate"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 2 AND l_returnflag <> 'N' AND l_linestatus = 'F'")
def filter_three_columns_and(spark, sf_dir):
    """Later predicates reject rows that earlier ones accept, and the other way round."""
    letters = {"l_orderkey": "q", "l_linenumber": "i", "l_returnflag": "s", "l_linestatus": "s"}
    q = Select(load(spark, sf_dir, "lineitem"), letters=letters).select(0, 1)
    q.where_equals(3, "F").where_value(2, lambda c: c != "N").where_value(1, lambda c: c >= 2)
    return as_values(q.run(), letters, ["l_orderkey", "l_linenumber"])


@query("SELECT event_id, nullif(event_type, 'click') AS event_type FROM events WHERE nullif(event_type, 'click') IS NULL OR contains(event_type, 'v')")
def filter_null_accepting(spark, sf_dir):
    df = load(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"))
    letters = {"event_id": "q", "event_type": "s"}
    q = Select(as_bytes(df, letters)).select(0, 1).where(1, lambda c: c.isNull() | F.contains(c, F.lit(b"v")))
    return as_values(q.run(), letters)


@query("SELECT event_id FROM events WHERE nullif(event_type, 'click') <> 'view'")
def filter_null_rejecting(spark, sf_dir):
    """An unknown answer is no: two values of truth."""
    df = load(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"))
    letters = {"event_id": "q", "event_type": "s"}
    return as_values(Select(as_bytes(df, letters)).select(0).where(1, lambda c: c != F.lit(b"view")).run(), letters, ["event_id"])


@query("SELECT c_custkey, c_name FROM customer WHERE length(c_mktsegment) % 2 = 0")
def filter_udf_predicate(spark, sf_dir):
    letters = {"c_custkey": "q", "c_name": "s", "c_mktsegment": "s"}
    q = Select(as_bytes(load(spark, sf_dir, "customer"), letters)).select(0, 1).where_call(2, lambda v: v is not None and len(v) % 2 == 0)
    return as_values(q.run(), letters, ["c_custkey", "c_name"])


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def filter_count_only(spark, sf_dir):
    """A filter without a selection: rows without columns, which can be counted."""
    return Select(load(spark, sf_dir, "lineitem"), letters={"l_returnflag": "s"}).where_equals(0, "R").run().agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE contains(o_orderpriority, 'URGENT')")
def filter_col_not_projected(spark, sf_dir):
    letters = {"o_orderkey": "q", "o_orderpriority": "s"}
    return as_values(Select(load(spark, sf_dir, "orders"), letters=letters).select(0).where_contains(1, "URGENT").run(), letters, ["o_orderkey"])


@query("SELECT r_regionkey, CAST(NULL AS VARCHAR) AS missing FROM region")
def select_absent_column(spark, sf_dir):
    """A column that the table lacks is null."""
    got = Select(as_bytes(load(spark, sf_dir, "region"), {"r_regionkey": "i"})).select(0, 9).run()
    return got.select(scalars.decode(F.col("c0"), "i").alias("r_regionkey"), F.col("c9").cast("string").alias("missing"))


# Order.


@query("SELECT n_name, row_number() OVER (ORDER BY encode(n_name), encode(CAST(n_regionkey AS VARCHAR)), encode(CAST(n_nationkey AS VARCHAR))) AS ordinal FROM nation")
def sort_full_row(spark, sf_dir):
    got = ordering.with_ordinals(ordering.sort_rows(_wide(spark, sf_dir, "nation", "n_name", "n_regionkey", "n_nationkey")))
    return got.select(F.col("c0").cast("string").alias("n_name"), "ordinal")


@query("""SELECT o_orderstatus, o_orderpriority, o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderpriority, encode(CAST(o_orderkey AS VARCHAR))) AS ordinal FROM orders""")
def sort_orders(spark, sf_dir):
    got = ordering.with_ordinals(ordering.sort_rows(_wide(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority", "o_orderkey")))
    return got.select(F.col("c0").cast("string").alias("o_orderstatus"), F.col("c1").cast("string").alias("o_orderpriority"), F.col("c2").cast("string").cast("long").alias("o_orderkey"), "ordinal")


@query("""SELECT event_id, nullif(event_type, 'click') AS event_type,
 row_number() OVER (ORDER BY nullif(event_type, 'click') NULLS FIRST, encode(CAST(event_id AS VARCHAR))) AS ordinal FROM events""")
def sort_nulls_first(spark, sf_dir):
    df = load(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("click")).alias("t"), F.col("event_id").cast("string").alias("e"))
    got = ordering.with_ordinals(ordering.sort_rows(model.numbered(df)))
    return got.select(F.col("c1").cast("string").cast("long").alias("event_id"), F.col("c0").cast("string").alias("event_type"), "ordinal")


@query("""SELECT doc_id, row_number() OVER (ORDER BY encode(text), encode(CAST(doc_id AS VARCHAR))) AS ordinal FROM documents""")
def sort_binary_order(spark, sf_dir):
    got = ordering.with_ordinals(ordering.sort_rows(_wide(spark, sf_dir, "documents", "text", "doc_id")))
    return got.select(F.col("c1").cast("string").cast("long").alias("doc_id"), "ordinal")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS a, o_orderkey % 3 = 0 AS has_c,
 o_orderkey % 2 = 0 AS has_b, o_orderpriority AS p FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY a IS NOT NULL, a, CASE WHEN has_b THEN 0 WHEN has_c THEN 1 ELSE -1 END,
 CASE WHEN has_b THEN p END, CASE WHEN has_b AND has_c THEN 1 ELSE 0 END, CASE WHEN has_c THEN encode(CAST(o_orderkey AS VARCHAR)) END, o_orderkey) AS ordinal FROM r""")
def sort_ragged_exact(spark, sf_dir):
    """Rows that lack columns: (0), (0, 1), (0, 2) or (0, 1, 2)."""
    df = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cell = lambda i, v: F.struct(F.lit(i).cast("long").alias("id"), v.cast("binary").alias("v"))
    parts = F.array(
        F.when(F.lit(True), cell(0, F.when(k % 4 != 0, F.col("o_orderstatus")))),
        F.when(k % 2 == 0, cell(1, F.col("o_orderpriority"))),
        F.when(k % 3 == 0, cell(2, k.cast("string"))),
    )
    exact = df.select(F.array_compact(parts).alias("row"), "o_orderkey")
    # Equal rows are told apart by the key, so that each has its own place.
    got = ordering.with_ordinals(exact.orderBy(F.col("row").asc_nulls_first(), "o_orderkey"))
    return got.select("o_orderkey", "ordinal")


@query("""WITH m AS (SELECT o_orderkey, o_orderstatus FROM orders) SELECT o_orderstatus, o_orderkey,
 row_number() OVER (ORDER BY o_orderstatus, encode(CAST(o_orderkey AS VARCHAR))) AS ordinal FROM m""")
def merge_sorted(spark, sf_dir):
    wide = _wide(spark, sf_dir, "orders", "o_orderstatus", "o_orderkey")
    some = [ordering.sort_rows(wide.where(F.col("c0") == F.lit(s))) for s in (b"F", b"O")] + [ordering.sort_rows(wide.where(~F.col("c0").isin(b"F", b"O")))]
    got = ordering.with_ordinals(ordering.merge(*some))
    return got.select(F.col("c0").cast("string").alias("o_orderstatus"), F.col("c1").cast("string").cast("long").alias("o_orderkey"), "ordinal")


# Bags.


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 12 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey >= 8")
def concat_bag(spark, sf_dir):
    letters = {"c_custkey": "q", "c_name": "s"}
    df = load(spark, sf_dir, "customer")
    return as_values(setops.concat(*(as_bytes(df.where(x), letters) for x in ("c_nationkey < 12", "c_nationkey >= 8"))), letters)


@query("SELECT r_regionkey AS k, r_name AS a, NULL AS b FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def concat_ragged(spark, sf_dir):
    a = as_bytes(load(spark, sf_dir, "region"), {"r_regionkey": "i", "r_name": "s"})
    b = as_bytes(load(spark, sf_dir, "nation"), {"n_nationkey": "i", "n_name": "s"}).withColumnRenamed("c1", "c2")
    return as_values(setops.concat(a, b), {"k": "i", "a": "s", "b": "s"})


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def append_segments(spark, sf_dir):
    letters, path = {"r_regionkey": "i", "r_name": "s"}, shared_path(spark, "append")
    wide = as_bytes(load(spark, sf_dir, "region"), letters)
    write_segments(wide, path)
    write_segments(wide, path, "zlib")
    return as_values(read_segments(spark, path), letters)


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def append_parquet(spark, sf_dir):
    path, df = shared_path(spark, "rows"), load(spark, sf_dir, "nation")
    setops.append(df, path)
    setops.append(df.where("n_regionkey = 1"), path)
    return spark.read.parquet(path).select("n_nationkey", "n_name")


# Values.


def _roundtrip(letter: str, expr: str, table: str, key: str):
    def run(spark, sf_dir):
        df = load(spark, sf_dir, table).select(F.col(key), F.expr(expr).alias("v"))
        stored = df.select(key, scalars.encode(F.col("v"), letter).alias("b"))
        return stored.select(key, scalars.decode(F.col("b"), letter).alias("v"), F.octet_length("b").alias("n_bytes"))

    return run


for _letter, _expr, _table, _key, _sql, _n in (
    ("H", "l_orderkey % 65536", "lineitem", "l_linenumber", "CAST(l_orderkey % 65536 AS INTEGER)", 2),
    ("I", "4294967295 - o_orderkey", "orders", "o_orderkey", "4294967295 - o_orderkey", 4),
    ("Q", "cast(18446744073709551615 as decimal(20,0)) - o_orderkey", "orders", "o_orderkey", "CAST(18446744073709551615 - CAST(o_orderkey AS HUGEINT) AS DECIMAL(20,0))", 8),
    ("h", "cast(l_orderkey % 65536 - 32768 as int)", "lineitem", "l_linenumber", "CAST(l_orderkey % 65536 - 32768 AS SMALLINT)", 2),
    ("i", "cast(500 - o_custkey as int)", "orders", "o_orderkey", "CAST(500 - o_custkey AS INTEGER)", 4),
    ("q", "(o_orderkey - 700) * 1000000007", "orders", "o_orderkey", "(o_orderkey - 700) * 1000000007", 8),
    ("d", "c_acctbal / 7", "customer", "c_custkey", "c_acctbal / 7", 8),
    ("f", "cast(c_acctbal as float)", "customer", "c_custkey", "CAST(c_acctbal AS FLOAT)", 4),
):
    _name = f"decode_{_letter}" if _letter.isupper() else f"decode_{_letter}_{'float' if _letter in 'df' else 'signed'}"
    QUERIES[_name] = _roundtrip(_letter, _expr, _table, _key)
    SQL[_name] = f"SELECT {_key}, {_sql} AS v, {_n} AS n_bytes FROM {_table}"


@query("SELECT doc_id, lower(hex(encode(text))) AS h FROM documents")
def decode_hex(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", scalars.decode(F.col("text").cast("binary"), "x").alias("h"))


@query("SELECT n_nationkey, n_name AS v FROM nation")
def decode_text(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", scalars.decode(scalars.encode(F.col("n_name"), "s"), "s").alias("v"))


@query("SELECT o_orderkey, CASE WHEN v < 128 THEN 1 WHEN v < 8192 THEN 2 WHEN v < 1048576 THEN 3 WHEN v < 134217728 THEN 4 ELSE 5 END AS n FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 37) % 4294967296 AS v FROM orders)")
def varint_length(spark, sf_dir):
    v = (F.col("o_orderkey") * F.col("o_orderkey") * 37) % (1 << 32)
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.varint_length(v).alias("n"))


@query("SELECT o_orderkey, (o_orderkey * o_orderkey * 37) % 4294967296 AS v, CASE WHEN v < 128 THEN 1 WHEN v < 8192 THEN 2 WHEN v < 1048576 THEN 3 WHEN v < 134217728 THEN 4 ELSE 5 END AS n FROM orders")
def varint_roundtrip(spark, sf_dir):
    v = (F.col("o_orderkey") * F.col("o_orderkey") * 37) % (1 << 32)
    coded = load(spark, sf_dir, "orders").select("o_orderkey", scalars.varint_encode(v).alias("b"))
    return coded.select("o_orderkey", scalars.varint_decode(F.col("b")).alias("v"), F.octet_length("b").alias("n"))


@query("SELECT o_orderkey, CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END AS z, n FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * o_custkey * 1009 AS n FROM orders)")
def zigzag(spark, sf_dir):
    n = F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1) * F.col("o_custkey") * 1009
    z = load(spark, sf_dir, "orders").select("o_orderkey", scalars.zigzag_encode(n).alias("z"))
    return z.select("o_orderkey", "z", scalars.zigzag_decode(F.col("z")).cast("long").alias("n"))


# Text.


@query("SELECT concat_ws(chr(9), CAST(n_nationkey AS VARCHAR), coalesce(nullif(n_name, 'CANADA'), ''), CAST(n_regionkey AS VARCHAR)) AS line FROM nation")
def text_render(spark, sf_dir):
    df = load(spark, sf_dir, "nation").withColumn("n_name", F.nullif("n_name", F.lit("CANADA")))
    return textout.render(as_bytes(df, {"n_nationkey": "i", "n_name": "s", "n_regionkey": "H"}), "isH")


@query("SELECT concat_ws(chr(9), CAST(o_orderkey AS VARCHAR), lower(hex(encode(o_orderstatus)))) AS line FROM orders")
def text_formats(spark, sf_dir):
    """A column is left out, one is hexadecimal, and the last is beyond the formats' end."""
    return textout.render(as_bytes(load(spark, sf_dir, "orders"), {"o_orderkey": "q", "o_custkey": "q", "o_orderstatus": "s", "o_orderpriority": "s"}), "q_x")


@query("SELECT concat_ws(chr(9), CAST(p_partkey AS VARCHAR), p_name) AS line FROM part WHERE contains(p_name, 'an') AND contains(p_brand, '3')")
def text_filter(spark, sf_dir):
    return textout.print_rows(as_bytes(load(spark, sf_dir, "part"), {"p_partkey": "q", "p_name": "s", "p_brand": "s"}), "qs", [(1, "an"), (2, "3")])


@query("SELECT concat(chr(9), n_name) AS line FROM nation WHERE contains(n_name, '1') AND contains(n_name, 'ION_2')")
def text_filter_only(spark, sf_dir):
    """Filters without formats print the filters' columns only."""
    return textout.print_rows(as_bytes(load(spark, sf_dir, "nation"), {"n_nationkey": "i", "n_name": "s"}), "", [(1, "1"), (1, "ION_2")])


@query("SELECT line FROM (SELECT concat_ws(chr(9), r_name, CAST(r_regionkey AS VARCHAR)) AS line FROM region)")
def text_file(spark, sf_dir):
    path = shared_path(spark, "text")
    textout.write_text(_wide(spark, sf_dir, "region", "r_name", "r_regionkey"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# Coding.

_RUNS_SQL = """WITH o AS (SELECT l_orderkey % 16 AS seg, l_returnflag AS v,
 row_number() OVER (PARTITION BY l_orderkey % 16 ORDER BY l_orderkey, l_linenumber, l_returnflag) AS n FROM lineitem),
f AS (SELECT *, CASE WHEN n = 1 OR v <> lag(v) OVER (PARTITION BY seg ORDER BY n) THEN 1 ELSE 0 END AS new FROM o),
r AS (SELECT *, sum(new) OVER (PARTITION BY seg ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT seg, CAST(run AS BIGINT) AS run, max(v) AS value, count(*) AS n FROM r GROUP BY seg, run"""


@query(_RUNS_SQL)
def rle_runs(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 16).alias("seg"), "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("v"))
    return encode_stats.runs(df, "v", ["seg"], ["l_orderkey", "l_linenumber", "v"])


@query("""WITH o AS (SELECT c_nationkey, c_custkey, c_name, lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS p FROM customer),
n AS (SELECT *, len(list_filter(range(1, 65), lambda k: k <= length(c_name) AND k <= length(p) AND left(c_name, k) = left(p, k))) AS k FROM o)
SELECT c_custkey, CASE WHEN k > 2 THEN CAST(k AS INTEGER) ELSE 0 END AS prefix FROM n""")
def prefix_len(spark, sf_dir):
    df = load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    return encode_stats.prefix_lengths(df, "c_name", ["c_nationkey"], ["c_name", "c_custkey"]).select("c_custkey", "prefix")


# Segment files.


def _stored(letters: dict[str, str], table: str, compression: str):
    def run(spark, sf_dir):
        path = shared_path(spark, compression)
        write_segments(as_bytes(load(spark, sf_dir, table), letters), path, compression, segment_bytes=1 << 16)
        return as_values(read_segments(spark, path), letters)

    return run


for _kind in ("none", "snappy", "lz4", "lzma", "zlib"):
    QUERIES[f"roundtrip_{_kind}"] = _stored(SUPPLIER, "supplier", _kind)
    SQL[f"roundtrip_{_kind}"] = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query(f"SELECT {', '.join(PART)} FROM part")
def recompress(spark, sf_dir):
    a, b = shared_path(spark, "first"), shared_path(spark, "second")
    write_segments(as_bytes(load(spark, sf_dir, "part"), PART), a, "none")
    tools.rewrite(spark, [a], b, "deflate")
    return as_values(read_segments(spark, b), PART)


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def segment_pruned_read(spark, sf_dir):
    """Only two of five columns' bytes are fetched."""
    path = shared_path(spark, "pruned")
    write_segments(as_bytes(load(spark, sf_dir, "orders"), ORDERS), path, segment_bytes=1 << 18)
    return as_values(read_segments(spark, path, columns=[0, 4]), ORDERS, ["o_orderkey", "o_orderpriority"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def segment_filtered_read(spark, sf_dir):
    """Two of five columns are fetched, the filter's first; a segment without a hit gives up there."""
    path = shared_path(spark, "filtered")
    write_segments(as_bytes(load(spark, sf_dir, "orders"), ORDERS), path, segment_bytes=1 << 18)
    return as_values(Select.files(spark, path).select(0).where_equals(2, "P").run(), ORDERS, ["o_orderkey"])


@query("SELECT count(*) AS n FROM orders")
def segment_row_count(spark, sf_dir):
    """Rows are counted without any column's values."""
    path = shared_path(spark, "count")
    write_segments(as_bytes(load(spark, sf_dir, "orders"), {"o_orderkey": "q"}), path)
    return read_segments(spark, path, columns=[]).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def segment_multi_file(spark, sf_dir):
    a, b = shared_path(spark, "one"), shared_path(spark, "two")
    write_segments(as_bytes(load(spark, sf_dir, "nation"), {"n_nationkey": "i", "n_name": "s"}), a)
    write_segments(as_bytes(load(spark, sf_dir, "region"), {"r_regionkey": "i", "r_name": "s"}), b)
    return as_values(read_segments(spark, a, b), {"n_nationkey": "i", "n_name": "s"})


@query("SELECT s_suppkey, s_name FROM supplier")
def segment_store_read(spark, sf_dir):
    """Files that only Spark's readers open."""
    path = shared_path(spark, "store")
    write_segments(as_bytes(load(spark, sf_dir, "supplier"), SUPPLIER), path)
    return as_values(read_store(spark, path, [0, 1]), SUPPLIER, ["s_suppkey", "s_name"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey <= m * 3 // 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END END AS o_orderstatus,
 CASE WHEN o_orderkey > m * 3 // 4 THEN 'absent' WHEN o_orderkey % 2 = 0 THEN 'value' ELSE 'null' END AS state FROM orders, (SELECT max(o_orderkey) AS m FROM orders)""")
def segment_exact_rows(spark, sf_dir):
    """Null is not absent: the last quarter of the rows lacks the second column, others hold a value or a null."""
    path = shared_path(spark, "exact")
    df = load(spark, sf_dir, "orders")
    bound = df.agg(F.max("o_orderkey")).first()[0] * 3 // 4
    for low, letters in ((True, {"o_orderkey": "q", "o_orderstatus": "s"}), (False, {"o_orderkey": "q"})):
        some = df.where(F.col("o_orderkey") <= bound if low else F.col("o_orderkey") > bound)
        some = some.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("o_orderstatus"))
        write_segments(model.to_exact(as_bytes(some, letters)), path)
    row = F.col("row")
    state = F.when(~F.exists(row, lambda x: x["id"] == 1), "absent").when(model.cell(row, 1).isNull(), "null").otherwise("value")
    got = read_segments(spark, path, mode="exact").select(model.cell(row, 0).alias("c0"), model.cell(row, 1).alias("c1"), state.alias("state"))
    return got.select(scalars.decode(F.col("c0"), "q").alias("o_orderkey"), F.col("c1").cast("string").alias("o_orderstatus"), "state")


@query("SELECT n_nationkey, n_name, 1 AS n FROM nation UNION ALL SELECT r_regionkey, r_name, 2 FROM region")
def memory_tables(spark, sf_dir):
    """Tables in memory: one is encoded in each task, another appended to the same bytes, and all decoded again."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column("a").to_pylist():
                some = json.loads(data)
                f = codec.encode([[(0, b"%d" % k), (1, name.encode())] for k, name in some["nation"]])
                f = codec.encode([[(0, b"%d" % k), (1, name.encode()), (2, b"")] for k, name in some["region"]], "zlib", onto=f)
                rows = [dict(r) for r in codec.decode(f)]
                yield pa.RecordBatch.from_pydict({"n_nationkey": [int(r[0]) for r in rows], "n_name": [r[1].decode() for r in rows], "n": [len(r) - 1 for r in rows]}, schema=pa.schema([("n_nationkey", pa.int32()), ("n_name", pa.string()), ("n", pa.int32())]))

    pairs = lambda t, k, v: load(spark, sf_dir, t).agg(F.collect_list(F.array(F.col(k).cast("string"), v)).alias(t))  # noqa: E731  tables of 25 and 5 rows
    both = pairs("nation", "n_nationkey", "n_name").join(pairs("region", "r_regionkey", "r_name"), F.lit(True)).select(F.to_json(F.struct("nation", "region")).alias("a"))
    text = both.withColumn("a", F.regexp_replace("a", r'\["(\d+)",', r"[$1,"))
    return text.mapInArrow(run, "n_nationkey int, n_name string, n int")


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER) AS seen, r_regionkey, r_name, r_regionkey < (SELECT max(r_regionkey) FROM region) AS more FROM region")
def cursor_rows(spark, sf_dir):
    """Row by row on the driver: a look ahead, a way back to the start, how far it is, and the end."""
    letters = {"r_regionkey": "i", "r_name": "s"}
    rows = Select(ordering.sort_rows(as_bytes(load(spark, sf_dir, "region"), letters))).select(0, 1).cursor()
    first, again = next(rows), rows.peek()
    assert again == next(rows) != first
    rows.rewind()
    out = [(rows.offset, int.from_bytes(r[0][1], "little"), r[1][1].decode(), not rows.end) for r in rows]
    return spark.createDataFrame(out, "seen int, r_regionkey int, r_name string, more boolean")


@query("SELECT count(*) AS n, sum(o_orderkey) AS total FROM orders WHERE o_orderstatus = 'F'")
def execute_callback(spark, sf_dir):
    """A function is called with each row where the row is; it adds to accumulators."""
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def call(row) -> None:
        n.add(1)
        total.add(int.from_bytes(row[0][1], "little"))

    Select(load(spark, sf_dir, "orders"), letters={"o_orderkey": "q", "o_orderstatus": "s"}).select(0).where_equals(1, "F").execute(call)
    return spark.createDataFrame([(n.value, total.value)], "n long, total long")


@query("SELECT s_suppkey, s_name, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 7 AS INTEGER) AS segment FROM supplier")
def writer_segments(spark, sf_dir):
    """A writer that ends a segment when its pending size says so, and is finished twice."""

    def run(batches):
        import pyarrow as pa

        f = BytesIO()
        w = codec.SegmentWriter(f)
        for batch in batches:
            for k, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w.put(0, b"%d" % k)
                w.put(1, name.encode())
                w.put(2, None)
                if len(w.columns[2]) == 7:
                    assert w.pending == sum(len(v or b"1") for c in w.columns.values() for v in c)
                    w.flush()
                    assert w.pending == 0
        w.finish()
        size = f.tell()
        assert w.finish().tell() == size
        for n, (_, s) in enumerate(codec.segments(f)):
            got = codec.read_segment(f, s, [0, 1])
            yield pa.RecordBatch.from_pydict({"s_suppkey": [int(x) for x in got[0].to_pylist()], "s_name": [x.decode() for x in got[1].to_pylist()], "segment": pa.array([n] * len(got[0]), pa.int32())})

    one = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name").coalesce(1).sortWithinPartitions("s_suppkey")  # a writer is one file
    return one.mapInArrow(run, "s_suppkey long, s_name string, segment int")


@query("SELECT o_orderstatus, o_orderkey, row_number() OVER (ORDER BY o_orderstatus, encode(CAST(o_orderkey AS VARCHAR))) AS ordinal FROM orders")
def segment_sort_files(spark, sf_dir):
    """Files in, one sorted table out."""
    a, b, out = (shared_path(spark, x) for x in ("a", "b", "sorted"))
    wide = _wide(spark, sf_dir, "orders", "o_orderstatus", "o_orderkey")
    write_segments(wide.where(F.col("c0") == F.lit(b"O")), a)
    write_segments(wide.where(F.col("c0") != F.lit(b"O")), b)
    tools.sort(spark, [a, b], out)
    got = ordering.with_ordinals(ordering.sort_rows(read_segments(spark, out)))
    return got.select(F.col("c0").cast("string").alias("o_orderstatus"), F.col("c1").cast("string").cast("long").alias("o_orderkey"), "ordinal")


@query("SELECT concat_ws(chr(9), CAST(s_suppkey AS VARCHAR), s_name) AS line FROM supplier WHERE contains(s_name, '7')")
def segment_show(spark, sf_dir):
    path = shared_path(spark, "show")
    write_segments(as_bytes(load(spark, sf_dir, "supplier"), SUPPLIER), path)
    return tools.show(spark, [path], "qs", ["1:7"])


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def segment_stream(spark, sf_dir):
    """Segments that are appended while a stream reads, each once."""
    path, out, state = (shared_path(spark, x) for x in ("grows", "seen", "state"))
    letters = {"k": "i", "name": "s"}
    write_segments(as_bytes(load(spark, sf_dir, "region").toDF("k", "name"), letters), path)
    source = spark.readStream.format("segcol").option("columns", "0,1").load(path)
    for more in (True, False):
        run = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        if more:
            write_segments(as_bytes(load(spark, sf_dir, "nation").select("n_nationkey", "n_name").toDF("k", "name"), letters), path)
    return as_values(spark.read.schema(model.wide_schema([0, 1])).parquet(out), letters).toDF("r_regionkey", "r_name")


# Nested records.

LINE = T.StructType([T.StructField("partkey", T.LongType()), T.StructField("quantity", T.DoubleType()), T.StructField("flag", T.StringType())])
ORDER = T.StructType([
    T.StructField("orderkey", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("note", T.StringType(), True, {"union": True}),
    T.StructField("lines", T.ArrayType(LINE)),
    T.StructField("customer", T.StructType([T.StructField("custkey", T.LongType())])),
])


def _order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines, in order of number and part."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag"))).alias("ls")
    )
    orders = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    of = F.transform("ls", lambda x: F.struct(x["l_partkey"].alias("partkey"), x["l_quantity"].alias("quantity"), x["l_returnflag"].alias("flag")))
    record = F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note"), of.alias("lines"), F.struct(F.col("o_custkey").alias("custkey")).alias("customer"))
    return orders.select(F.col("o_orderkey").alias("key"), record.cast(ORDER).alias("record")).select("key", F.col("record").alias("record", metadata={}))


def _typed(df: DataFrame) -> DataFrame:
    """A struct keeps its fields' metadata only through a schema."""
    return df.select("key", F.struct(*(F.col(f"record.{f.name}").alias(f.name, metadata=f.metadata) for f in ORDER)).alias("record"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS pos FROM lineitem),
s AS (SELECT o_orderkey AS key, 0 AS id, '' AS places, CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT o_orderkey, 1, '', o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, 3, '', CAST(count(l_orderkey) AS VARCHAR) FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
UNION ALL SELECT l_orderkey, 4, CAST(pos AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM l
UNION ALL SELECT l_orderkey, 6, CAST(pos AS VARCHAR), l_returnflag FROM l
UNION ALL SELECT o_orderkey, 7, '', CAST(o_custkey AS VARCHAR) FROM orders)
SELECT key, CAST(id AS BIGINT) AS id, places, v FROM s WHERE key IN (SELECT o_orderkey FROM orders)""")
def shred_orders(spark, sf_dir):
    """Streams of all columns; of column 5, a floating-point one, nothing is printed."""
    got = nested.shred(_typed(_order_records(spark, sf_dir)), "record", "key").where("id <> 5")
    text = F.when(F.col("id").isin(0, 3, 4, 7), scalars.decode_integer(F.when(F.col("id").isin(0, 3, 4, 7), F.col("v")), "q").cast("string")).otherwise(F.col("v").cast("string"))
    return got.select("key", "id", F.concat_ws(",", F.col("pos").cast("array<string>")).alias("places"), text.alias("v"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS pos FROM lineitem)
SELECT o_orderkey AS orderkey, o_orderstatus AS status, o_custkey AS custkey, CAST(pos AS INTEGER) AS pos, l_partkey AS partkey, l_quantity AS quantity, l_returnflag AS flag
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def assemble_orders(spark, sf_dir):
    """Shredded and put together again, then flattened."""
    records = nested.assemble(nested.shred(_typed(_order_records(spark, sf_dir)), "record", "key"), ORDER)
    flat = records.select("record.orderkey", "record.status", F.col("record.customer.custkey").alias("custkey"), F.posexplode_outer("record.lines").alias("pos", "x"))
    return flat.select("orderkey", "status", "custkey", "pos", "x.partkey", "x.quantity", "x.flag")


@query("SELECT * FROM (VALUES ('line', 3), ('order', 8), ('orders', 9), ('list of list', 3), ('void', 1)) AS t(what, n)")
def field_count(spark, sf_dir):
    kinds = {
        "line": LINE,
        "order": ORDER,
        "orders": T.ArrayType(ORDER),
        "list of list": T.ArrayType(T.ArrayType(T.LongType())),
        "void": T.StructType([T.StructField("nothing", T.NullType()), T.StructField("x", T.LongType())]),
    }
    return spark.createDataFrame([(k, nested.field_count(v)) for k, v in kinds.items()], "what string, n int")
