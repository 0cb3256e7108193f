import random
from io import BytesIO

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segtable.errors import SegmentError
from segtable.sources import codec

MONTHS = [
    [(0, b"2000-01-01"), (1, b"January"), (2, b"First")],
    [(0, b"2000-01-02"), (1, b"January"), (2, b"Second")],
    [(0, b"2000-02-02"), (1, b"February"), (2, b"Second")],
    [(0, b"2000-02-03"), (1, b"February"), (2, b"Third")],
    [(0, b"2000-02-03"), (1, None), (2, None)],
]
GOLDEN = bytes.fromhex(
    "0A092200 00000008 0003 001A 0115 0211"
    "01000A 323030302D30312D3031 0100C70132 0100C404322D3032"
    "020007 4A616E75617279 010008 4665627275617279"
    "010005 4669727374 020006 5365636F6E64"
    "00000008 0003 000D 010E 020B"
    "02000A 323030302D30322D3033 010008 4665627275617279 0100FF 010005 5468697264 0100FF"
)


def test_golden_bytes():
    assert codec.encode(MONTHS, "none", segment_rows=3) == GOLDEN
    assert list(codec.decode(GOLDEN)) == MONTHS


@pytest.mark.parametrize("kind", codec.COMPRESSIONS)
def test_roundtrip(kind):
    rows = [*MONTHS[:3], [(0, b"2000-02-03"), (1, b"February"), (2, b"x" * 4095)], MONTHS[4]]
    data = codec.encode(rows, kind, segment_rows=2)
    assert list(codec.decode(data)) == rows
    assert list(codec.decode(data, [1])) == [[c for c in r if c[0] == 1] for r in rows]
    assert list(codec.decode(codec.encode(MONTHS, kind, data))) == rows + MONTHS


def test_names():
    assert codec.compression("deflate") == codec.compression("zlib") == 4
    with pytest.raises(ValueError):
        codec.compression("zstd")


#: Values around the places where one more byte is taken.
UNSIGNED = [0, 0x10, 0x7F, 0x80, 0x100, 0x1000, 0x3FFF, 0x4000, 0x10000, 0x100000, 0x1FFFFF, 0x200000, 0x1000000, 0xFFFFFFF, 0x10000000, 0xFFFFFFFF, 2**13 - 1, 2**13, 2**20 - 1, 2**20, 2**27 - 1, 2**27]


@pytest.mark.parametrize("n", UNSIGNED)
def test_varint(n):
    data = codec.put_varint(n)
    assert codec.get_varint(data, 0) == (n, len(data))
    assert data[0] & 0xC0 != 0xC0
    assert len(data) == 1 + sum(n >= b for b in (2**7, 2**13, 2**20, 2**27))


def test_varint_errors():
    for data in (b"\x80", b"", b"\x80\x80\x80\x80\x20", b"\x80\x80\x80\x80\x80"):
        with pytest.raises(SegmentError):
            codec.get_varint(data, 0)
    for n in (-1, 1 << 32):
        with pytest.raises(SegmentError):
            codec.put_varint(n)


@given(st.lists(st.one_of(st.none(), st.binary(max_size=6), st.sampled_from([b"", b"abc", b"abcd" * 20, b"abcd" * 20 + b"x"])), max_size=40))
@settings(max_examples=200, deadline=None)
def test_runs(values):
    assert codec.decode_runs(codec.encode_runs(values)).to_pylist() == values


def test_prefixes():
    """Shared starts of 2, 3, 64 and 65 bytes; none across a null."""
    assert codec.encode_runs([b"abX", b"abY"]) == b"\x01\x00\x03abX\x01\x00\x03abY"
    assert codec.encode_runs([b"abcX", b"abcY"]) == b"\x01\x00\x04abcX\x01\x00\xc1\x01Y"
    for n in (64, 65):
        a, b = b"a" * n + b"1", b"a" * n + b"2"
        data = codec.encode_runs([a, b])
        assert data[len(codec.encode_runs([a])) + 2] == 0xC0 | 62
        assert codec.decode_runs(data).to_pylist() == [a, b]
    assert codec.encode_runs([b"abcd", None, b"abce"]).endswith(b"\x01\x00\xff\x01\x00\x04abce")


def test_ragged():
    """A column that has run out is absent; a gap in between is filled with nulls."""
    data = codec.encode([[(0, b"a"), (1, b"x")], [(0, b"b")], [(0, b"c")]])
    assert list(codec.decode(data)) == [[(0, b"a"), (1, b"x")], [(0, b"b")], [(0, b"c")]]
    data = codec.encode([[(0, b"a")], [(0, b"b"), (1, b"y")]])
    assert list(codec.decode(data)) == [[(0, b"a"), (1, None)], [(0, b"b"), (1, b"y")]]
    assert list(codec.decode(codec.MAGIC)) == []


def test_writer():
    f = BytesIO()
    w = codec.SegmentWriter(f)
    w.put(3, b"v")
    w.put(3, None)
    assert w.pending == 2
    w.flush()
    w.flush()
    assert w.finish() is w.finish()
    assert list(codec.decode(f.getvalue())) == [[(3, b"v")], [(3, None)]]


@pytest.mark.parametrize("kind", codec.COMPRESSIONS)
def test_damage(kind):
    """Cut or changed bytes give the one error, or rows; nothing else."""
    data = codec.encode(MONTHS, kind, segment_rows=3)
    rng = random.Random(5)
    cases = [data[:k] for k in range(len(data))]
    for k in range(len(data)):
        changed = bytearray(data)
        changed[k] ^= 1 << rng.randrange(8)
        cases.append(bytes(changed))
    failed = 0
    for case in cases:
        try:
            for _, row in zip(range(10_000), codec.decode(case), strict=False):
                assert all(v is None or isinstance(v, bytes) for _, v in row)
        except SegmentError:
            failed += 1
    assert failed > len(data) // 2


def test_errors():
    for data in (b"", b"\x0a\x09\x22", b"PAR1", GOLDEN[:-1]):
        with pytest.raises(SegmentError):
            list(codec.decode(data))
    for run in (b"\x01\x01\x00", b"\x00\x00\x00", b"\x01\x00\xc5\x01x", b"\x01\x00\x05ab", b"\x01\x00"):
        with pytest.raises(SegmentError):
            codec.decode_runs(run)
    with pytest.raises(SegmentError):
        codec.decompress(b"", 9)


def _column(rng, n):
    out = []
    for _ in range(n):
        r = rng.random()
        out.append(None if r < 0.15 else out[-1] if r < 0.4 and out else b"stem" * rng.randrange(40) + rng.randbytes(rng.randrange(3)))
    return out


@pytest.mark.parametrize("once", [1, 3, 1 << 16])
def test_runs_across_blocks(monkeypatch, once):
    """Runs and prefixes go on where one block of values ends; blocks make no difference to the bytes, and both decoders agree."""
    rng = random.Random(once)
    for _ in range(200):
        values = _column(rng, rng.randrange(40))
        monkeypatch.setattr(codec, "AT_ONCE", 1 << 16)
        want = codec.encode_runs(values)
        monkeypatch.setattr(codec, "AT_ONCE", once)
        assert codec.encode_runs(values) == want
        assert codec.decode_runs(want).to_pylist() == values == [v for n, v in codec.runs(want) for _ in range(n)]
        assert codec.count_values(want) == len(values)
        runs = [v for _, v in codec.runs(want)]
        assert all(a != b for a, b in zip(runs, runs[1:], strict=False))


def test_work_is_not_by_value(monkeypatch):
    """Runs of small numbers are read without a call for each, and no value becomes a Python object."""
    values = [b"%07d" % k for k in range(5000)]
    data = codec.encode_runs(values)
    calls = []
    one = codec.get_varint
    monkeypatch.setattr(codec, "get_varint", lambda *a: calls.append(a) or one(*a))
    assert codec.decode_runs(data).to_pylist() == values and len(calls) < 50


def test_columns_of_rows():
    """Whole columns of exact rows are what rows one by one would put."""
    import pyarrow as pa

    from segtable.sources import segcol

    rng = random.Random(9)
    for _ in range(100):
        rows = [[(i, None if rng.random() < 0.3 else rng.randbytes(2)) for i in sorted(rng.sample(range(5), rng.randrange(4)))] for _ in range(rng.randrange(9))]
        w = codec.SegmentWriter(BytesIO())
        for row in rows:
            w.put_row(row)
        array = pa.array([[{"id": i, "v": v} for i, v in row] for row in rows], pa.list_(segcol.ARROW_CELL))
        assert {i: v.to_pylist() for i, v in segcol.columns_of(array).items()} == w.columns
    assert segcol.columns_of(pa.array([[{"id": 1, "v": b"a"}, {"id": 1, "v": b"b"}]], pa.list_(segcol.ARROW_CELL))) is None
