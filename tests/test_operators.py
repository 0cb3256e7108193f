import decimal
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtable import model
from segtable.functions import scalars
from segtable.operators import nested, ordering, setops, textout
from segtable.operators.select import Select
from segtable.sources.segcol import read_segments, write_segments


def table(spark, rows, n=2):
    return spark.createDataFrame([tuple(None if v is None else bytearray(v) for v in r) for r in rows], model.wide_schema(range(n)))


def values(df):
    return [tuple(None if v is None else bytes(v) for v in r) for r in df.collect()]


def test_two_filters_early_reject(spark):
    """One filter accepts rows 0 and 5, the other rows 1 and 5."""
    rows = [(b"k" if i in (0, 5) else b"-", b"y" if i in (1, 5) else b"-") for i in range(6)]
    for a, b in ((0, 1), (1, 0)):
        q = Select(table(spark, rows)).where_contains(a, b"k" if a == 0 else b"y").where_contains(b, b"k" if b == 0 else b"y").select(0, 1)
        assert values(q.run()) == [(b"k", b"y")]


def test_nulls_and_empty_selection(spark):
    df = table(spark, [(None, b"a"), (b"x", None), (b"xy", b"b")])
    assert values(Select(df).select(1).where(0, lambda c: c != F.lit(b"x")).run()) == [(b"b",)]
    assert values(Select(df).select(1).where_call(0, lambda v: v is None).run()) == [(b"a",)]
    assert Select(df).where_contains(0, b"x").run().columns == []
    assert Select(df).where_contains(0, b"x").run().count() == 2
    assert Select(df).run().columns == ["c0", "c1"]
    assert list(Select(df).select(1, 0).where(0, lambda c: c.isNull()).rows()) == [[(0, None), (1, b"a")]]
    with pytest.raises(KeyError):
        Select(df, strict=True).select(7).run()


def test_execute(spark, tmp_path):
    def call(row):
        with open(tmp_path / str(len(row)), "ab") as f:
            f.write(row[0][1])

    Select(table(spark, [(b"a", b"1"), (b"a", b"2")])).select(0).execute(call)
    assert (tmp_path / "1").read_bytes() == b"aa"


def test_order(spark):
    got = ordering.sort_rows(table(spark, [(b"\x80",), (b"\x7f\x00",), (b"",), (None,), (b"\x7f",)], 1))
    assert [r[0] for r in values(got)] == [None, b"", b"\x7f", b"\x7f\x00", b"\x80"]
    assert values(ordering.sort_rows(table(spark, []))) == []
    assert ordering.with_ordinals(ordering.sort_rows(table(spark, []))).count() == 0
    assert ordering.is_sorted(got).where("NOT sorted").count() == 0


def test_exact_order_and_states(spark):
    rows = [[(0, b"a"), (1, b"b")], [(0, b"a")], [(0, b"a"), (2, b"b")], [(0, None)], []]
    df = spark.createDataFrame([([(i, None if v is None else bytearray(v)) for i, v in r],) for r in rows], model.EXACT)
    got = [[(c["id"], None if c["v"] is None else bytes(c["v"])) for c in r["row"]] for r in ordering.sort_exact(df).collect()]
    assert got == [[], [(0, None)], [(0, b"a")], [(0, b"a"), (1, b"b")], [(0, b"a"), (2, b"b")]]
    assert values(model.from_exact(df.limit(1), [1, 3])) == [(b"b", None)]
    assert [len(r["row"]) for r in model.to_exact(table(spark, [(None, b"a")]), null_is_absent=True).collect()] == [1]


def test_concat(spark):
    a, b = table(spark, [(b"1", b"2")]), table(spark, [(b"3",)], 1).withColumnRenamed("c0", "c7")
    got = setops.concat(a, b)
    assert got.columns == ["c0", "c1", "c7"]
    assert sorted(values(got), key=repr) == sorted([(b"1", b"2", None), (None, None, b"3")], key=repr)


def test_scalars(spark):
    cases = [("H", 0xFFFE), ("I", 0xFFFFFFFE), ("Q", 2**64 - 1), ("h", -32768), ("i", -2), ("q", -(2**63)), ("q", 2**63 - 1)]
    for letter, n in cases:
        raw = struct.pack("<" + letter, n)
        df = spark.createDataFrame([(bytearray(raw + b"more"), str(n)), (None, None)], "b binary, n string")
        got = df.select(scalars.decode(F.col("b"), letter).alias("v"), scalars.encode(F.col("n").cast("decimal(20,0)"), letter).alias("e")).collect()
        assert int(got[0]["v"]) == n and bytes(got[0]["e"]) == raw
        assert got[1]["v"] is None and got[1]["e"] is None
    floats = [0.0, -0.0, 1.5, -2.25e-310, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 0.1]
    df = spark.createDataFrame([(bytearray(struct.pack("<d", x)), bytearray(struct.pack("<f", min(x, 3e38)))) for x in floats], "d binary, f binary")
    for x, r in zip(floats, df.select(scalars.decode(F.col("d"), "d"), scalars.decode(F.col("f"), "f"), scalars.encode(scalars.decode(F.col("d"), "d"), "d")).collect(), strict=True):
        assert struct.pack("<d", r[0]) == struct.pack("<d", x) or x != x and r[0] != r[0]
        assert struct.pack("<f", r[1]) == struct.pack("<f", min(x, 3e38)) or x != x
        assert x != x or bytes(r[2]) == struct.pack("<d", x)
    short = spark.createDataFrame([(bytearray(b"a"),)], "b binary")
    for letter in "Hd":
        with pytest.raises(Exception, match="bytes is expected"):
            short.select(scalars.decode(F.col("b"), letter)).collect()
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(scalars.encode(F.lit(65536), "H")).collect()


def test_varints_and_zigzag(spark):
    from segtable.sources.codec import put_varint

    from .test_codec import UNSIGNED

    df = spark.createDataFrame([(n,) for n in UNSIGNED], "n long").withColumn("b", scalars.varint_encode(F.col("n")))
    for r in df.select("n", "b", scalars.varint_decode(F.col("b")).alias("d"), scalars.varint_length(F.col("n")).alias("l")).collect():
        assert bytes(r["b"]) == put_varint(r["n"]) and r["d"] == r["n"] and r["l"] == len(r["b"])
    signed = [0, -1, 1, 0x10000000, -0x7FFFFFFF, -(2**31), 2**31 - 1]
    z = spark.createDataFrame([(n,) for n in signed], "n long").withColumn("z", scalars.zigzag_encode(F.col("n")))
    for r in z.select("n", "z", scalars.zigzag_decode(F.col("z")).alias("d")).collect():
        assert r["d"] == r["n"] and r["z"] == (2 * r["n"] if r["n"] >= 0 else -2 * r["n"] - 1)


def test_text(spark):
    df = table(spark, [(None, b"a"), (b"x", None)])
    assert [r[0] for r in textout.render(df).collect()] == ["\ta", "x\t"]
    assert [r[0] for r in textout.render(df, "x_").collect()] == ["", "78"]
    assert [r[0] for r in textout.print_rows(df, "", [(0, "x"), (0, "x")]).collect()] == ["x"]
    assert [r[0] for r in textout.print_rows(df, "", [(1, "a")]).collect()] == ["\ta"]
    numbers = table(spark, [(struct.pack("<d", 1e6), struct.pack("<f", 0.1)), (struct.pack("<d", 123456789.0), None)])
    assert [r[0] for r in textout.render(numbers, "df").collect()] == ["1e+06\t0.1", "1.23457e+08\t"]
    assert textout.parse_filter("3:a:b") == (3, "a:b")
    with pytest.raises(ValueError):
        textout.parse_filter("3")
    with pytest.raises(ValueError):
        textout.render(df, "z").collect()


def test_nested(spark):
    phone = T.StructType([T.StructField("number", T.StringType()), T.StructField("type", T.IntegerType(), True, {"letter": "H"})])
    work = T.StructType([T.StructField(x, T.StringType(), True, {"union": True}) for x in ("employer", "school")])
    person = T.StructType([T.StructField("id", T.LongType(), True, {"letter": "I"}), T.StructField("name", T.StringType()), T.StructField("email", T.StringType()), T.StructField("phones", T.ArrayType(phone)), T.StructField("employment", work)])
    book = T.StructType([T.StructField("people", T.ArrayType(person))])
    assert [nested.field_count(x) for x in (phone, person, book)] == [2, 8, 9]
    data = ([(31, "Ines", "ines@mail.test", [("0171-20", 0)], None), (702, "Olaf", "olaf@mail.test", [], None)],)
    df = spark.createDataFrame([(1, data), (2, (None,))], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("r", book)]))
    streams = nested.shred(df, "r", "k")
    first = {}
    for r in streams.where("key = 1").orderBy("id", "pos").collect():
        first.setdefault(r["id"], []).append(bytes(r["v"]))
    assert {i: len(v) for i, v in first.items()} == {0: 1, 1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1}
    assert first[0] == [struct.pack("<Q", 2)] and first[1] == [struct.pack("<I", n) for n in (31, 702)]
    assert first[4] == [struct.pack("<Q", n) for n in (1, 0)] and first[6] == [struct.pack("<H", 0)]
    back = {r["key"]: r["record"] for r in nested.assemble(streams, book).collect()}
    assert [(p["id"], p["name"], [tuple(x) for x in p["phones"]]) for p in back[1]["people"]] == [(31, "Ines", [("0171-20", 0)]), (702, "Olaf", [])]
    assert back[2]["people"] == []
    deep = T.LongType()
    for _ in range(300):
        deep = T.ArrayType(deep)
    with pytest.raises(ValueError):
        nested.field_count(deep)


def test_lists_of_lists_and_scalars(spark):
    kind = T.StructType([T.StructField("a", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("b", T.ArrayType(T.StringType())), T.StructField("t", T.BooleanType()), T.StructField("d", T.DoubleType())])
    rows = [(1, ([[1, 2], [], [3]], ["x", None], True, 2.5)), (2, ([], [], False, None))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("k", T.IntegerType()), T.StructField("r", kind)]))
    back = {r["key"]: tuple(r["record"]) for r in nested.assemble(nested.shred(df, "r", "k"), kind).collect()}
    assert back == dict(rows)


def test_segment_source(spark, tmp_path):
    path = str(tmp_path / "t")
    df = table(spark, [(b"a", None), (b"b", b"x")])
    write_segments(df, path, "snappy")
    write_segments(table(spark, [(b"z",)], 1).withColumnRenamed("c0", "c4"), path)
    got = read_segments(spark, path)
    assert got.columns == ["c0", "c1", "c4"] and got.count() == 3
    assert sorted(values(read_segments(spark, path, columns=[1, 9])), key=repr) == sorted([(None, None), (b"x", None), (None, None)], key=repr)
    with pytest.raises(Exception, match="none of the asked columns"):
        read_segments(spark, path, columns=[9], strict=True).collect()
    assert sorted(map(len, (r["row"] for r in read_segments(spark, path, mode="exact").collect()))) == [1, 2, 2]
    write_segments(df.limit(1), path, mode="overwrite")
    assert values(read_segments(spark, path)) == [(b"a", None)]
    empty = str(tmp_path / "e")
    write_segments(df.where("false"), empty)
    assert read_segments(spark, empty, columns=[0]).count() == 0
    with pytest.raises(ValueError):
        write_segments(df, path, "zstd")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.seg").write_bytes(b"nothing of this kind")
    with pytest.raises(Exception, match="no segment table"):
        read_segments(spark, str(tmp_path / "bad"), columns=[0]).collect()


def test_pushed_filter(spark, tmp_path):
    path = str(tmp_path / "p")
    write_segments(table(spark, [(b"a", b"1"), (None, b"2"), (b"b", b"3")]).coalesce(1), path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for test, want in ((F.col("c0") == F.lit(b"b"), [b"3"]), (F.col("c0").isNull(), [b"2"]), (F.col("c0").isin(b"a", b"x"), [b"1"]), (F.col("c0") == F.lit(b"q"), [])):
            assert [r[0] for r in values(read_segments(spark, path).where(test).select("c1"))] == want
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bits_of_floats(spark):
    """Every kind of number, bit by bit: signs, zeros, subnormal, largest, infinite, none."""
    import random

    rng = random.Random(3)
    some = [0.0, -0.0, 1.0, -2.5, 5e-324, -2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 1e-45, 1.1754943508222875e-38, 3e-39, 3.4e38]
    some += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(300)] + [struct.unpack("<f", rng.randbytes(4))[0] for _ in range(300)] + [rng.uniform(-1e4, 1e4) for _ in range(100)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(some)], "k int, v double")
    rows = df.select("v", scalars.float_bits(F.col("v"), "d").alias("d"), F.col("v").cast("float").alias("w"), scalars.float_bits(F.col("v"), "f").alias("f")).collect()
    for r in rows:
        if r["v"] == r["v"]:
            assert bytes(r["d"]) == struct.pack("<d", r["v"]) and bytes(r["f"]) == struct.pack("<f", r["w"]), r["v"]
        else:
            assert bytes(r["d"]) == struct.pack("<d", float("nan")) and bytes(r["f"]) == struct.pack("<f", float("nan"))


def test_shred_is_one_pass(spark):
    """Without a shuffle, however many list levels; assembling takes one."""
    kind = T.StructType([T.StructField("a", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("b", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(1, ([[1, 2], [], [3]], ["x", None]))], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("r", kind)]))
    streams = nested.shred(df, "r", "k")
    plan = lambda d: d._jdf.queryExecution().sparkPlan().toString()
    prepared = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in prepared(streams) and "Union" not in plan(streams)
    assert prepared(nested.assemble(streams, kind)).count("Exchange") == 1


def test_shred_works_on_columns(spark):
    """No expression runs for a cell by itself, and what assembling shuffles is a row for a record, not for a cell."""
    import random
    from collections import Counter

    rng = random.Random(5)
    line = T.StructType([T.StructField("n", T.IntegerType(), True, {"letter": "H"}), T.StructField("x", T.DoubleType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("nothing", T.NullType())])
    kind = T.StructType([
        T.StructField("u", T.DecimalType(20, 0)),
        T.StructField("b", T.BooleanType()),
        T.StructField("f", T.FloatType()),
        T.StructField("by_text", T.IntegerType(), True, {"letter": "q"}),
        T.StructField("raw", T.BinaryType()),
        T.StructField("lines", T.ArrayType(line)),
        T.StructField("in", T.StructType([T.StructField("h", T.ShortType()), T.StructField("hex", T.StringType(), True, {"letter": "x"})])),
    ])
    maybe = lambda v: None if rng.random() < 0.2 else v

    def record(lines):
        got = [(maybe(rng.randrange(1 << 16)), maybe(rng.uniform(-9, 9)), [maybe("é" * rng.randrange(4)) for _ in range(rng.randrange(3))], None) for _ in range(lines)]
        return (maybe(decimal.Decimal(rng.choice([0, 2**63, 2**64 - 1]))), maybe(rng.random() < 0.5), maybe(-0.5), maybe(-(2**31)), maybe(bytearray(rng.randbytes(rng.randrange(3)))), got, (maybe(-5), maybe("00ff")))

    # The longest record is of several batches, and its cells and others' come in any order.
    rows = [(k, record(rng.choice([0, 1, 5]))) for k in [float("nan"), None, *map(float, range(300))]] + [(-1.0, record(9000))]
    schema = T.StructType([T.StructField("k", T.DoubleType()), T.StructField("r", kind)])
    plain = lambda x: tuple(plain(y) for y in x) if isinstance(x, (tuple, list)) else bytes(x) if isinstance(x, bytearray) else x
    want = Counter((str(k), plain(r)) for k, r in rows)
    streams = nested.shred(spark.createDataFrame(rows, schema), "r", "k")
    assert "lambda" not in streams._jdf.queryExecution().toString()
    for some in (streams, streams.repartition(3, "v")):
        assert Counter((str(r["key"]), plain(r["record"])) for r in nested.assemble(some, kind).collect()) == want
    # Before: as many as there are cells.
    packed = streams.mapInArrow(nested._packed, T.StructType([streams.schema["key"], *nested.PACK])).count()
    assert packed < len(rows) + streams.count() / 1000 + 50
    with pytest.raises(Exception, match="out of range for H"):
        nested.shred(spark.createDataFrame([(1.0, (None,) * 5 + ([(1 << 16, None, [], None)], None))], schema), "r", "k").collect()
    with pytest.raises(Exception, match="bytes is expected"):
        nested.assemble(streams.withColumn("v", F.expr("substring(v, 1, 1)")), kind).collect()


def test_assemble_takes_streams_that_lack_cells(spark):
    """A place without a cell is null."""
    kind = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType())]))), T.StructField("b", T.LongType())])
    df = spark.createDataFrame([(1, ([(1, "x"), (2, "y")], 5)), (2, ([(3, "z")], 6))], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("r", kind)]))
    some = nested.shred(df, "r", "k").where("NOT (key = 1 AND (id = 3 OR id = 2 AND pos[0] = 1))")
    got = {r["key"]: r["record"] for r in nested.assemble(some, kind).collect()}
    assert [tuple(x) for x in got[1]["a"]] == [(1, "x"), (2, None)] and got[1]["b"] is None
    assert [tuple(x) for x in got[2]["a"]] == [(3, "z")] and got[2]["b"] == 6
