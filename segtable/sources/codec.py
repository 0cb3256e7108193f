"""The segment format: runs of values, compressed column by column, behind a small header.

A table is a mark and any number of segments.  A segment's header lists its columns and the
bytes that each takes, so a reader fetches only those it wants.  A column is a sequence of
*runs*; work is done per run, not per row.
"""

from __future__ import annotations

import lzma
import zlib
from array import array
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from io import BytesIO
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from segtable.errors import SegmentError

# Fixed by the format: the mark, the numbers of the compressions, the codes in a run.
MAGIC = b"\x0a\x09\x22\x00"
COMPRESSIONS = {"none": 0, "snappy": 1, "lz4": 2, "lzma": 3, "zlib": 4}
DEFAULT = "lz4"
NULL_RUN = 0xFF
PREFIX_RUN = 0xC0
LEAST_PREFIX, MOST_PREFIX = 3, 64
SEGMENT_BYTES = 16 << 20
VARINT_BOUNDS = (1 << 7, 1 << 13, 1 << 20, 1 << 27)
#: Values that are encoded at once; what that takes is several times the values themselves.
AT_ONCE = 1 << 16
#: No column of a segment may say that it unpacks to more than this.
MOST_BYTES = 1 << 31


def compression(name: str) -> int:
    """The number of a compression; ``deflate`` is another name of ``zlib``."""
    name = "zlib" if name == "deflate" else name
    if name not in COMPRESSIONS:
        raise ValueError(f"unknown compression {name!r}; there are {', '.join(COMPRESSIONS)}")
    return COMPRESSIONS[name]


def put_varint(n: int) -> bytes:
    """An unsigned 32-bit integer; the first of several bytes has 6 bits of it, later ones 7."""
    if n < 0x80:
        return bytes((n,)) if n >= 0 else _too_large(n)
    out = bytearray((n & 0x3F | 0x80,))
    n >>= 6
    while n >= 0x80 and len(out) < 4:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    if n > (0x7F if len(out) < 4 else 0x1F):
        _too_large(n)
    out.append(n)
    return bytes(out)


def _too_large(n: int) -> bytes:
    raise SegmentError(f"integer out of range: {n}")


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """The integer at a place, and the place behind it."""
    try:
        b = data[at]
        if b < 0x80:
            return b, at + 1
        n, shift = b & 0x7F, 6
        for _ in range(4):
            at += 1
            b = data[at]
            if shift == 27 and b > 0x1F:
                raise SegmentError("corrupt input: integer out of range")
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n, at + 1
            shift += 7
    except IndexError:
        raise SegmentError("corrupt input: the data end within an integer") from None
    raise SegmentError("corrupt input: integer out of range")


def common_prefix(a: bytes, b: bytes) -> int:
    """How many bytes two values share at their start, up to the most that a run can take over."""
    most = min(len(a), len(b), MOST_PREFIX)
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def _varints(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of unsigned 32-bit integers, and their bytes: a row of five for each, of which the first count."""
    n = n.astype(np.int64)
    if len(n) and (n.min() < 0 or n.max() >= 1 << 32):
        _too_large(int(n.min() if n.min() < 0 else n.max()))
    size = np.digitize(n, VARINT_BOUNDS) + 1
    out = np.zeros((len(n), 5), np.uint8)
    for k in range(5):
        low = n & 0x3F if k == 0 else n >> (7 * k - 1) & 0x7F
        out[:, k] = np.where(size == k + 1, n if k == 0 else n >> (7 * k - 1), low | 0x80)
    return size, out


#: Pieces longer than this are copied one by one, others many at once.
PIECE = 64


def _copy(out: np.ndarray, to: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
    """Pieces of the data, each to its place."""
    for t, a, n in zip(*(x[size > PIECE].tolist() for x in (to, at, size)), strict=True):
        out[t : t + n] = data[a : a + n]
    small = np.flatnonzero((size > 0) & (size <= PIECE))
    for k in range(0, len(small), 1 << 14):
        some = small[k : k + (1 << 14)]
        n = size[some]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to[some], n) + within] = data[np.repeat(at[some], n) + within]


def _shared(data: np.ndarray, at: np.ndarray, size: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of each value how many bytes it shares with the one before, up to the most that a run can take over."""
    n = len(at)
    shared = np.zeros(n, np.int64)
    if n < 2 or not len(data):
        return shared
    most = np.zeros(n, np.int64)
    most[1:] = np.where(good[1:] & good[:-1], np.minimum(np.minimum(size[1:], size[:-1]), MOST_PREFIX), 0)
    left = np.flatnonzero(most > 0)
    for k in range(MOST_PREFIX):
        left = left[data[at[left] + k] == data[at[left - 1] + k]]
        shared[left] = k + 1
        left = left[most[left] > k + 1]
        if not len(left):
            break
    return shared


def encode_runs(values: pa.Array | Sequence[bytes | None]) -> bytes:
    """A column as runs: equal neighbours are one, and one may take over the start of the one before."""
    whole = values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, pa.large_binary())
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.combine_chunks()
    whole = whole.cast(pa.large_binary())
    # Some values at a time; a run that goes on is left to the next ones, of which the first is the last of these.
    out, done, before, pending = [], 0, None, 0
    while done < len(whole):
        some = whole.slice(done, AT_ONCE)
        done += len(some)
        data, before, pending = _encode_some(some, before, pending, done == len(whole))
        out.append(data)
    return b"".join(out)


def _encode_some(some: pa.Array, before: pa.Array | None, pending: int, last: bool) -> tuple[bytes, pa.Array, int]:
    """Runs of some values.

    ``before``: the last two runs' values before these (or one), of which the second is not written yet;
    it has ``pending`` values.  The same are returned for what comes next.
    """
    lead = 0 if before is None else len(before)
    both = some if before is None else pa.concat_arrays([before, some])
    n = len(both)
    good = both.is_valid().to_numpy(zero_copy_only=False)
    same = np.zeros(max(n - 1, 0), bool)
    if n > 1:
        same = pc.equal(both[:-1], both[1:]).fill_null(False).to_numpy(zero_copy_only=False) | ~good[1:] & ~good[:-1]
    if lead == 2:
        same[0] = False
    start = np.concatenate([[0], np.flatnonzero(~same) + 1])
    count = np.diff(np.append(start, n))
    if lead:  # the value that isn't written yet stands for all of its run
        count[lead - 1] += pending - 1
    _, offsets, raw = both.buffers()
    place = np.frombuffer(offsets, np.int64)[both.offset : both.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at, size, good = place[start], np.where(good[start], place[start + 1] - place[start], 0), good[start]
    shared = _shared(data, at, size, good)
    shared[shared < LEAST_PREFIX] = 0
    first, stop = (1 if lead == 2 else 0), len(start) if last else len(start) - 1
    keep = slice(first, max(first, stop))
    taken = start[max(0, len(start) - 2) :]
    rest = both.take(pa.array(taken)), int(count[-1])
    count, at, size, good, shared = (x[keep] for x in (count, at, size, good, shared))
    # Pieces of a run: how often, the reserved 0, a code or none, the size, the bytes.
    n_size, n_bytes = _varints(count)
    s_size, s_bytes = _varints(size - shared)
    code = ~good | (shared > 0)
    s_size = np.where(good, s_size, 0)
    head = n_size + 1
    own = size - shared
    whole = head + code + s_size + own
    begin = np.cumsum(whole) - whole
    out = np.zeros(int(whole.sum()), np.uint8)
    for k in range(5):
        m = n_size > k
        out[begin[m] + k] = n_bytes[m, k]
        m = s_size > k
        out[begin[m] + head[m] + code[m] + k] = s_bytes[m, k]
    out[begin[code] + head[code]] = np.where(good[code], PREFIX_RUN | shared[code] - 2, NULL_RUN)
    _copy(out, begin + head + code + s_size, data, at + shared, own)
    return out.tobytes(), *rest


def runs(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """The runs of a column: how often, and the value or None."""
    at, end, before = 0, len(data), b""
    while at < end:
        n, at = get_varint(data, at)
        reserved, at = get_varint(data, at)
        if reserved:
            raise SegmentError("incompatible format: a reserved number is not zero")
        if not n:
            raise SegmentError("corrupt input: a run of no values")
        if at >= end:
            raise SegmentError("corrupt input: the data end within a run")
        code = data[at]
        if code == NULL_RUN:
            at += 1
            yield n, None
            continue
        if code >= PREFIX_RUN:
            shared = (code & 0x3F) + 2
            size, at = get_varint(data, at + 1)
            if shared > len(before):
                raise SegmentError("corrupt input: a shared prefix is longer than the value before")
            value = before[:shared] + data[at : at + size]
        else:
            shared = 0
            size, at = get_varint(data, at)
            value = data[at : at + size]
        if at + size > end:
            raise SegmentError("corrupt input: a value is longer than the data")
        at += size
        before = value
        yield n, value


def run_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: how often, where its own bytes are, how many (-1: null), and how many it takes over.

    No value is made.  For all places of a block at once it is told how long a run would be that began
    there, if its numbers take one byte each; then only the places are followed.  Other runs are read singly.
    """
    raw, end, at = np.frombuffer(data, np.uint8), len(data), 0
    parts = []
    while at < end:
        base, m = at, min(AT_ONCE, end - at - 3)
        block = raw[base : base + m + 3].astype(np.int16) if m > 0 else np.zeros(3, np.int16)
        n, reserved, code, more = block[: len(block) - 3], block[1 : len(block) - 2], block[2 : len(block) - 1], block[3:]
        step = np.where(code < 0x80, 3 + code, np.where(code == NULL_RUN, 3, np.where((code >= PREFIX_RUN) & (more < 0x80), 4 + more, 0)))
        far = np.where((n > 0) & (n < 0x80) & (reserved == 0), step, 0).tolist()
        starts, single = array("q"), []
        while at - base < m:
            if size := far[at - base]:
                starts.append(at)
                at += size
            else:
                single.append((len(starts), *(one := _one_run(data, at))))
                starts.append(at)
                at = one[1] + max(one[2], 0)
            if at > end:
                raise SegmentError("corrupt input: a value is longer than the data")
        if m <= 0:
            single.append((0, *(one := _one_run(data, at))))
            starts.append(at)
            at = one[1] + max(one[2], 0)
            if at > end:
                raise SegmentError("corrupt input: a value is longer than the data")
        k = np.frombuffer(starts, np.int64)
        many, code = raw[k].astype(np.int64), raw[np.minimum(k + 2, end - 1)].astype(np.int64)
        null, prefix = code == NULL_RUN, code >= PREFIX_RUN
        place = np.where(prefix & ~null, k + 4, k + 3)
        own = np.where(null, -1, np.where(prefix, raw[np.minimum(k + 3, end - 1)], code))
        got = np.stack([many, place, own, np.where(prefix & ~null, (code & 0x3F) + 2, 0)])
        if single:
            at_, *columns = zip(*single, strict=True)
            got[:, list(at_)] = np.array(columns)
        parts.append(got)
    count, place, own, take = np.concatenate(parts, 1) if parts else np.zeros((4, 0), np.int64)
    size = (own + take)[own >= 0]
    if (take[own >= 0] > np.concatenate([[0], size[:-1]])[: len(size)]).any():
        raise SegmentError("corrupt input: a shared prefix is longer than the value before")
    return count, place, own, take


def _one_run(data: bytes, at: int) -> tuple[int, int, int, int]:
    """A run at a place: how often, where its own bytes are, how many, and how many it takes over."""
    n, at = get_varint(data, at)
    reserved, at = get_varint(data, at)
    if reserved:
        raise SegmentError("incompatible format: a reserved number is not zero")
    if not n:
        raise SegmentError("corrupt input: a run of no values")
    if at >= len(data):
        raise SegmentError("corrupt input: the data end within a run")
    code = data[at]
    if code == NULL_RUN:
        return n, at + 1, -1, 0
    if code < PREFIX_RUN:
        size, at = get_varint(data, at)
        return n, at, size, 0
    size, at = get_varint(data, at + 1)
    return n, at, size, (code & 0x3F) + 2


def _values(data: bytes, place: np.ndarray, own: np.ndarray, take: np.ndarray) -> pa.Array:
    """One value for each run."""
    good = own >= 0
    n, raw = len(own), np.frombuffer(data, np.uint8)
    whole = np.where(good, own + take, 0)
    at = np.cumsum(whole) - whole
    total = int(whole.sum())
    if total > MOST_BYTES:
        raise SegmentError("corrupt input: a column is too large")
    out = np.empty(total, np.uint8)
    if len(raw) and (place + np.maximum(own, 0) > len(raw)).any():
        raise SegmentError("corrupt input: a value is longer than the data")
    _copy(out, at + take, raw, place, np.maximum(own, 0))
    # A byte that is taken over is that of the last value before which has its own there: byte by byte of the prefix.
    real = np.flatnonzero(good)
    for k in range(int(take.max(initial=0))):
        # Only those that have a byte k; in between none lacks it, or the prefix would be too long.
        have = real[whole[real] > k]
        source = np.where(take[have] <= k, np.arange(len(have)), 0)
        out[at[have] + k] = out[at[have[np.maximum.accumulate(source)]] + k]
    valid = None if good.all() else pa.py_buffer(np.packbits(good, bitorder="little"))
    where = pa.py_buffer(np.append(at, total).astype(np.int32 if total < 1 << 31 else np.int64))
    return pa.Array.from_buffers(pa.binary() if total < 1 << 31 else pa.large_binary(), n, [valid, where, pa.py_buffer(out)])


def decode_runs(data: bytes) -> pa.Array:
    """A column's values."""
    count, *runs_ = run_table(data)
    values = _values(data, *runs_)
    if (count == 1).all():
        return values
    if count.sum() > MOST_BYTES:
        raise SegmentError("corrupt input: too many values")
    return values.take(pa.array(np.repeat(np.arange(len(count)), count)))


def count_values(data: bytes) -> int:
    """How many values a column has."""
    return int(run_table(data)[0].sum())


def compress(data: bytes, kind: int) -> bytes:
    if kind == 0:
        return data
    if kind == 1:
        return pa.Codec("snappy").compress(data, asbytes=True)
    size = put_varint(len(data))
    if kind == 2:
        return size + pa.Codec("lz4_raw").compress(data, asbytes=True)
    if kind == 3:
        return size + lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_CRC32, preset=1)
    if kind == 4:
        return size + zlib.compress(data, 1)
    raise SegmentError(f"unknown compression {kind}")


def _snappy_size(data: bytes) -> int:
    """The size that a snappy block says it unpacks to: an integer of 7 bits a byte in front of it."""
    n = shift = 0
    for b in data[:5]:
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n
        shift += 7
    raise SegmentError("corrupt input: no snappy block")


def decompress(data: bytes, kind: int) -> bytes:
    if kind == 0:
        return data
    if kind not in COMPRESSIONS.values():
        raise SegmentError(f"unknown compression {kind}")
    size, at = (_snappy_size(data), 0) if kind == 1 else get_varint(data, 0)
    if size > MOST_BYTES:
        raise SegmentError("corrupt input: a column is too large")
    body = data[at:]
    try:
        if kind in (1, 2):
            out = pa.Codec("snappy" if kind == 1 else "lz4_raw").decompress(body, size, asbytes=True) if size else b""
        elif kind == 3:
            out = lzma.LZMADecompressor(lzma.FORMAT_XZ).decompress(body, size + 1)
        else:
            out = zlib.decompressobj().decompress(body, size + 1)
    except (OSError, lzma.LZMAError, zlib.error, pa.ArrowException, EOFError) as e:
        raise SegmentError(f"corrupt input: {e}") from None
    if len(out) != size:
        raise SegmentError("corrupt input: a column has not the size that it says")
    return out


@dataclass(frozen=True)
class Segment:
    """Where a segment's columns are: number, first byte and size of each, by number of column."""

    kind: int
    columns: tuple[tuple[int, int, int], ...]
    end: int

    def read(self, f: BinaryIO, number: int) -> bytes | None:
        """The unpacked runs of a column, or None if the segment has none of this number."""
        for i, at, size in self.columns:
            if i == number:
                f.seek(at)
                data = f.read(size)
                if len(data) < size:
                    raise SegmentError("corrupt input: the data end within a column")
                return decompress(data, self.kind)
        return None


def header(f: BinaryIO, at: int) -> Segment | None:
    """The segment at a place, or None at the end of the data."""
    f.seek(at)
    raw = f.read(4)
    if not raw:
        return None
    if len(raw) < 4:
        raise SegmentError("corrupt input: short read")
    size = int.from_bytes(raw, "big")
    if size > 1 << 26:
        raise SegmentError("corrupt input: a header is too large")
    data = f.read(size)
    if len(data) < size:
        raise SegmentError("corrupt input: the data end within a header")
    kind, p = get_varint(data, 0)
    if kind not in COMPRESSIONS.values():
        raise SegmentError(f"unknown compression {kind}")
    n, p = get_varint(data, p)
    place, columns = at + 4 + size, []
    for _ in range(n):
        number, p = get_varint(data, p)
        length, p = get_varint(data, p)
        columns.append((number, place, length))
        place += length
    if p != size:
        raise SegmentError("corrupt input: a header has not the size that it says")
    return Segment(kind, tuple(columns), place)


def check_magic(f: BinaryIO) -> None:
    f.seek(0)
    if f.read(4) != MAGIC:
        raise SegmentError("corrupt input: this is no segment table")


def segments(f: BinaryIO, at: int | None = None, end: int | None = None) -> Iterator[tuple[int, Segment]]:
    """Place and header of each segment, from the first or from a place on.  Bodies are skipped, not read."""
    size = f.seek(0, 2)
    if at is None:
        check_magic(f)
        at = len(MAGIC)
    while end is None or at < end:
        s = header(f, at)
        if s is None:
            return
        if s.end > size:
            raise SegmentError("corrupt input: the data end within a segment")
        yield at, s
        at = s.end


def read_segment(f: BinaryIO, segment: Segment, wanted: Iterable[int] | None = None) -> dict[int, pa.Array]:
    """The columns of a segment that are wanted (None: all), each as long as it is."""
    found = {}
    for number, _, _ in segment.columns:
        if wanted is None or number in wanted:
            found[number] = decode_runs(segment.read(f, number))
    return found


class SegmentWriter:
    """Writes columns or rows as segments; behind what a file holds already."""

    def __init__(self, f: BinaryIO, compression_: str = DEFAULT, empty: bool = True, segment_bytes: int = SEGMENT_BYTES):
        """``empty``: nothing is written yet, so the mark comes first."""
        self.f, self.kind, self.segment_bytes = f, compression(compression_), segment_bytes
        self.columns: dict[int, list] = {}
        self.pending = 0
        self.closed = False
        if empty:
            f.write(MAGIC)

    def put(self, column: int, value: bytes | None) -> None:
        """Append a value, or null, to one column."""
        self.columns.setdefault(column, []).append(value)
        self.pending += 1 if value is None else len(value)

    def put_row(self, row: Iterable[tuple[int, bytes | None]]) -> None:
        """Append a row of (column, value).  A column that is missing in between is filled up with nulls."""
        longest = max(map(len, self.columns.values()), default=0)
        for column, value in row:
            have = self.columns.setdefault(column, [])
            have += [None] * (longest - len(have))
            self.put(column, value)
        if self.pending > self.segment_bytes:
            self.flush()

    def put_columns(self, columns: Mapping[int, pa.Array]) -> None:
        """Write whole columns as a segment of their own."""
        self.flush()
        self._write({i: encode_runs(v) for i, v in sorted(columns.items()) if len(v)})

    def flush(self) -> None:
        """End the segment; nothing happens if it is empty."""
        self._write({i: encode_runs(v) for i, v in sorted(self.columns.items())})
        self.columns, self.pending = {}, 0

    def _write(self, encoded: dict[int, bytes]) -> None:
        if not encoded:
            return
        bodies = {i: compress(data, self.kind) for i, data in encoded.items()}
        head = put_varint(self.kind) + put_varint(len(bodies)) + b"".join(put_varint(i) + put_varint(len(b)) for i, b in bodies.items())
        self.f.write(len(head).to_bytes(4, "big") + head + b"".join(bodies.values()))

    def finish(self) -> BinaryIO:
        """Flush, and give the file back; again and again is harmless."""
        if not self.closed:
            self.flush()
            self.closed = True
        return self.f


def encode(rows: Iterable[Iterable[tuple[int, bytes | None]]], compression_: str = DEFAULT, onto: bytes = b"", segment_rows: int | None = None) -> bytes:
    """Rows of (column, value) as bytes, appended to a table in memory."""
    f = BytesIO()
    w = SegmentWriter(f, compression_, not onto)
    for k, row in enumerate(rows):
        if segment_rows and k and k % segment_rows == 0:
            w.flush()
        w.put_row(row)
    w.finish()
    return onto + f.getvalue()


def decode(data: bytes, wanted: Iterable[int] | None = None) -> Iterator[list[tuple[int, bytes | None]]]:
    """The rows of a table in memory; a column that has run out is absent from the rest of its segment."""
    f = BytesIO(data)
    for _, segment in segments(f):
        columns = sorted((i, v.to_pylist()) for i, v in read_segment(f, segment, wanted).items())
        for k in range(max((len(v) for _, v in columns), default=0)):
            yield [(i, v[k]) for i, v in columns if k < len(v)]
