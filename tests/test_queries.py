"""Every registered query of the engine against its SQL."""

import pytest

from segtable.plans import catalogue

from .compare import rows
from .conftest import SF


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and rows(got) == rows(want)


def test_entry():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_pruned_and_pushed(spark):
    """Filters and columns reach the Parquet scan, also those of the flagship."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = _plan(catalogue.filter_multi_column_and(spark, SF))
    assert "StringContains(l_returnflag,R)" in plan and "EqualTo(l_linestatus,F)" in plan
    assert "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[-1]
    assert "EqualTo(o_orderstatus,F)" in _plan(catalogue.filter_bytes_eq(spark, SF))
    assert "EqualTo(l_returnflag,R)" in _plan(catalogue.filter_count_only(spark, SF))
    assert "GreaterThanOrEqual(l_linenumber,2)" in _plan(catalogue.filter_three_columns_and(spark, SF))
    assert "StringContains(o_orderpriority,URGENT)" in _plan(catalogue.filter_col_not_projected(spark, SF))


def test_files_fetch_what_is_asked(spark, tmp_path, monkeypatch):
    """Of five columns two are fetched, and of segments without a hit only the filter's."""
    from segtable.operators.select import Select
    from segtable.sources import codec, segcol

    path, fetched = str(tmp_path / "t"), []
    segcol.write_segments(catalogue.as_bytes(catalogue.load(spark, SF, "orders").coalesce(1).orderBy("o_orderstatus"), catalogue.ORDERS), path, segment_bytes=1 << 12)
    q = Select.files(spark, path).select(0).where_equals(2, "P")
    assert q.run().columns == ["c0"] and q.df.columns == ["c0", "c2"]
    read = codec.Segment.read
    monkeypatch.setattr(codec.Segment, "read", lambda s, f, i: fetched.append(i) or read(s, f, i))
    reader = segcol._Reader({"paths": f'["{path}"]', "tests": '[[2, "=", "50"]]'}, q.df.schema)
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert set(fetched) == {0, 2} and fetched.count(2) > fetched.count(0) and rows >= q.run().count() > 0


def test_split_files(spark, tmp_path, monkeypatch):
    """Ranges of a file hold each segment once."""
    from segtable.sources import segcol

    path = str(tmp_path / "t")
    segcol.write_segments(catalogue.as_bytes(catalogue.load(spark, SF, "orders").coalesce(1), catalogue.ORDERS), path, segment_bytes=1 << 12)
    monkeypatch.setattr(segcol, "SPLIT", 5000)
    reader = segcol._Reader({"paths": f'["{path}"]'}, segcol.model.wide_schema([0]))
    some = reader.partitions()
    assert len(some) > 3 and sum(b.num_rows for p in some for b in reader.read(p)) == 1500


def test_batches_are_small(spark, tmp_path, monkeypatch):
    """A segment is given to Spark in parts, exact or not, and rows are counted without any value."""
    from segtable.sources import codec, segcol

    path = str(tmp_path / "t")
    df = catalogue.as_bytes(catalogue.load(spark, SF, "orders").coalesce(1), catalogue.ORDERS)
    segcol.write_segments(df, path)
    monkeypatch.setattr(segcol, "ROWS", 400)
    for options, schema in (({"mode": "exact"}, segcol.model.EXACT), ({"columns": "0,9"}, segcol.model.wide_schema([0, 9])), ({"columns": "-"}, segcol.model.wide_schema([]))):
        if options.get("columns") == "-":
            monkeypatch.setattr(codec, "decode_runs", None)
        reader = segcol._Reader({"paths": f'["{path}"]'} | options, schema)
        assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [400, 400, 400, 300]
    assert segcol.read_segments(spark, path, columns=[]).columns == []


def test_few_files_are_cut(spark, tmp_path, monkeypatch):
    """A table of one file is read by more than one task."""
    from segtable.sources import segcol

    path = str(tmp_path / "t")
    segcol.write_segments(catalogue.as_bytes(catalogue.load(spark, SF, "part").coalesce(1), catalogue.PART), path, segment_bytes=1 << 12)
    monkeypatch.setattr(segcol, "LEAST_SPLIT", 1000)
    reader = segcol._Reader({"paths": f'["{path}"]', "cores": "4"}, segcol.model.wide_schema([0]))
    assert len(reader.partitions()) == 4 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 200


def test_floats_are_decoded_at_once(spark):
    """A float is no expression of its hexadecimal digits, which were made again and again for each."""
    df = spark.range(1).select(catalogue.scalars.decode(catalogue.F.lit(b"\0" * 8), "d"))
    assert "ArrowEvalPython" in _plan(df) and "conv(" not in _plan(df)
