"""Values as bytes and back by the letters of ``scalars``, for whole Arrow arrays: no Python object for a value."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from segtable.errors import SegmentError

#: Letters of formats as numbers of NumPy.
NUMBERS = {x: np.dtype("<" + n) for x, n in {"H": "u2", "I": "u4", "Q": "u8", "h": "i2", "i": "i4", "q": "i8", "f": "f4", "d": "f8"}.items()}


def offsets(sizes: np.ndarray) -> np.ndarray:
    """Where values of these sizes begin, and the end."""
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    if at[-1] >= 1 << 31:
        raise ValueError("a batch is too large: 2 GB of one column")
    return at.astype(np.int32)


def validity(good: np.ndarray) -> pa.Buffer | None:
    return None if good.all() else pa.py_buffer(np.packbits(good, bitorder="little"))


def sizes_and_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The size of each value, -1 for null, and the bytes of all that are not."""
    if not pa.types.is_binary(values.type):
        values = values.cast(pa.binary())
    if values.null_count:  # what stands behind a null is no value
        good = values.is_valid().to_numpy(zero_copy_only=False)
        size, data = sizes_and_bytes(values.drop_null())
        out = np.full(len(values), -1, np.int32)
        out[good] = size
        return out, data
    n = len(values)
    _, at, data = values.buffers()
    if not n or data is None:
        return np.zeros(n, np.int32), np.zeros(0, np.uint8)
    at = np.frombuffer(at, np.int32)[values.offset : values.offset + n + 1]
    return np.diff(at), np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def of_numbers(numbers: np.ndarray, like: pa.Array | None = None) -> pa.Array:
    """The bytes of numbers; null where ``like`` is."""
    n, width = len(numbers), numbers.dtype.itemsize
    good = None if like is None or not like.null_count else validity(like.is_valid().to_numpy(zero_copy_only=False))
    return pa.Array.from_buffers(pa.binary(), n, [good, pa.py_buffer(offsets(np.full(n, width))), pa.py_buffer(np.ascontiguousarray(numbers))])


def encode(values: pa.Array, letter: str) -> pa.Array:
    """The bytes of each value."""
    if letter == "s":
        return values.cast(pa.binary())
    if letter == "x":
        return pa.array([None if v is None else _unhex(v) for v in values.to_pylist()], pa.binary())
    kind = NUMBERS[letter]
    if letter in "df":
        numbers = values.fill_null(0.0).to_numpy().astype(kind)
        return of_numbers(np.where(np.isnan(numbers), kind.type(np.nan), numbers), values)
    if pa.types.is_decimal(values.type):
        low, high = _halves(values)
        wrong = high != 0
        numbers = low
    else:
        numbers = values.fill_null(0).to_numpy()
        least, most = np.iinfo(kind).min, np.iinfo(kind).max
        wrong = (numbers < least) | (numbers > most) if most < 1 << 63 else numbers < 0
    if wrong.any():
        raise SegmentError(f"out of range for {letter}: {values[int(np.flatnonzero(wrong)[0])]}")
    return of_numbers(numbers.astype(kind), values)


def _unhex(text: str) -> bytes | None:
    return bytes.fromhex("0" * (len(text) % 2) + text) if re.fullmatch("[0-9A-Fa-f]*", text) else None


def _halves(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Decimals without a fraction as their lower and upper 64 bits; null as 0."""
    raw = np.frombuffer(values.buffers()[1], "<u8").reshape(-1, 2)[values.offset : values.offset + len(values)]
    if values.null_count:
        raw = np.where(values.is_valid().to_numpy(zero_copy_only=False)[:, None], raw, 0).astype("<u8")
    return raw[:, 0], raw[:, 1]


def numbers(values: pa.Array, letter: str) -> np.ndarray:
    """The number at the start of each value; 0 for null.  Fewer bytes are an error."""
    kind = NUMBERS[letter]
    size, data = sizes_and_bytes(values)
    short = (size >= 0) & (size < kind.itemsize)
    if short.any():
        raise SegmentError(f"a value of {kind.itemsize} bytes is expected, not of {size[short][0]}")
    if len(data) == len(size) * kind.itemsize and (size == kind.itemsize).all():
        return np.frombuffer(data.tobytes(), kind)
    size = np.maximum(size, 0)
    at = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.cumsum(size) - size, len(data))
    data = np.concatenate([data, np.zeros(kind.itemsize, np.uint8)])
    return np.ascontiguousarray(data[at[:, None] + np.arange(kind.itemsize)]).view(kind).reshape(-1)


def decode(values: pa.Array, letter: str, kind: pa.DataType) -> pa.Array:
    """The value that each has the bytes of."""
    if letter == "s":
        return values.view(pa.string())  # as Spark does, whatever the bytes
    if letter == "x":
        return pa.array([None if v is None else v.hex() for v in values.to_pylist()], pa.string())
    got = numbers(values, letter)
    null = ~values.is_valid().to_numpy(zero_copy_only=False) if values.null_count else None
    if pa.types.is_decimal(kind):
        both = np.column_stack([got.astype("<u8"), np.zeros(len(got), "<u8")])
        return pa.Array.from_buffers(kind, len(got), [None if null is None else validity(~null), pa.py_buffer(np.ascontiguousarray(both))])
    return pa.array(got.astype(kind.to_pandas_dtype()), kind, mask=null, from_pandas=False)
