"""Values as bytes and back: the letters of formats, hexadecimal, variable-length integers.

All but floating-point numbers are Column expressions that stay in the JVM.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import binary

#: Letters of formats: bytes, whether signed, and the type that holds every value.
INTEGERS = {
    "H": (2, False, "int"),
    "I": (4, False, "long"),
    "Q": (8, False, "decimal(20,0)"),
    "h": (2, True, "smallint"),
    "i": (4, True, "int"),
    "q": (8, True, "long"),
}
FLOATS = {"d": ("double", 11, 52, 8), "f": ("float", 8, 23, 4)}


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, for use within higher-order functions; elsewhere it ends generated code."""
    return F.transform(F.array(value), body)[0]


def _swapped(digits: Column, width: int, inner: bool = False) -> Column:
    """Hexadecimal digits of ``width`` bytes, last byte first."""
    swap = lambda d: F.concat(*(F.substring(d, 2 * k + 1, 2) for k in reversed(range(width))))
    return _once(digits, swap) if inner else swap(digits)


def _short(col: Column, width: int) -> Column:
    return F.raise_error(F.concat(F.lit(f"a value of {width} bytes is expected, not of "), F.octet_length(col).cast("string")))


def decode_integer(col: Column, letter: str, inner: bool = False) -> Column:
    """A little-endian integer; bytes beyond its width are not looked at, fewer are an error.

    ``inner``: for use within higher-order functions.
    """
    width, signed, kind = INTEGERS[letter]
    digits = _swapped(F.hex(F.substring(col, 1, width)), width, inner)
    if letter == "Q":
        value = F.conv(digits, 16, 10).cast(kind)
    elif letter == "q":
        value = F.conv(digits, 16, -10).cast("long")
    else:
        value = F.conv(digits, 16, 10).cast("long")
        if signed:
            half = F.lit(1 << (8 * width - 1)).cast("long")
            value = value.bitwiseXOR(half) - half
    return F.when(col.isNull(), F.lit(None)).when(F.octet_length(col) < width, _short(col, width).cast(kind)).otherwise(value.cast(kind))


def decode_float(col: Column, letter: str, inner: bool = False) -> Column:
    """A little-endian IEEE number: an Arrow UDF.

    ``inner``: within higher-order functions, where a UDF can't stand, it is put together from its sign, exponent and fraction.
    """
    kind, _, _, width = FLOATS[letter]
    if not inner:
        arrow = pa.float64() if letter == "d" else pa.float32()

        def run(values: pa.Array) -> pa.Array:
            return binary.decode(values, letter, arrow)

        return F.arrow_udf(run, kind)(col)
    digits = _swapped(F.hex(F.substring(col, 1, width)), width, True)
    return _once(digits, lambda d: _float_of(col, d, letter))


def _float_of(col: Column, digits: Column, letter: str) -> Column:
    """The number whose bytes have these digits, first byte first."""
    kind, exponent_bits, fraction_bits, width = FLOATS[letter]
    # The bits beside the sign fit into a long.
    top = F.conv(F.substring(digits, 1, 1), 16, 10).cast("int")
    bits = F.conv(F.concat(F.hex(top.bitwiseAND(7).cast("long")), F.substring(digits, 2, 2 * width - 1)), 16, 10).cast("long")
    exponent = F.shiftright(bits, fraction_bits)
    fraction = bits.bitwiseAND(F.lit((1 << fraction_bits) - 1)).cast("double")
    bias, full = (1 << (exponent_bits - 1)) - 1, (1 << exponent_bits) - 1
    sign = F.when(top >= 8, F.lit(-1.0)).otherwise(F.lit(1.0))
    size = (
        F.when((exponent == full) & (fraction == 0), F.lit(float("inf")))
        .when(exponent == full, F.lit(float("nan")))
        .when(exponent == 0, fraction * F.lit(2.0 ** (1 - bias - fraction_bits)))
        .otherwise(F.pow(F.lit(2.0), (exponent - bias).cast("double")) * (fraction / F.lit(float(1 << fraction_bits)) + 1.0))
    )
    return F.when(col.isNull(), F.lit(None)).when(F.octet_length(col) < width, _short(col, width).cast("double")).otherwise(sign * size).cast(kind)


def decode(col: Column, letter: str) -> Column:
    """A value by the letter of its format: integers and floats, ``s`` text, ``x`` hexadecimal."""
    if letter in INTEGERS:
        return decode_integer(col, letter)
    if letter in FLOATS:
        return decode_float(col, letter)
    if letter == "s":
        return col.cast("string")
    if letter == "x":
        return to_hex(col)
    raise ValueError(f"no format letter: {letter!r}")


def to_hex(col: Column) -> Column:
    """Two lower-case digits for each byte."""
    return F.lower(F.hex(col))


def encode_integer(col: Column, letter: str, inner: bool = False) -> Column:
    """The little-endian bytes of an integer; an error if it doesn't fit.  ``inner``: within higher-order functions."""
    width, signed, _ = INTEGERS[letter]
    if letter == "Q":
        wide = col.cast("decimal(20,0)")
        number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
        bits = F.when(wide > number((1 << 63) - 1), wide - number(1 << 64)).otherwise(wide).cast("long")
        fits = (wide >= number(0)) & (wide <= number((1 << 64) - 1))
    else:  # what is no long is an error of the cast
        wide = bits = col.cast("long")
        low, high = (-(1 << (8 * width - 1)), (1 << (8 * width - 1)) - 1) if signed else (0, (1 << (8 * width)) - 1)
        fits = F.lit(True) if width == 8 else (wide >= F.lit(low).cast("long")) & (wide <= F.lit(high).cast("long"))
    digits = F.substring(F.lpad(F.hex(bits), 16, "0"), 17 - 2 * width, 2 * width)
    wrong = F.raise_error(F.concat(F.lit(f"out of range for {letter}: "), wide.cast("string"))).cast("binary")
    return F.when(col.isNull(), F.lit(None)).when(fits, F.unhex(_swapped(digits, width, inner))).otherwise(wrong)


def encode_float(col: Column, letter: str) -> Column:
    """The little-endian bytes of a floating-point number.  SQL has no view of its bits: an Arrow UDF."""
    def run(values: pa.Array) -> pa.Array:
        return binary.encode(values, letter)

    return F.arrow_udf(run, "binary")(col.cast("double" if letter == "d" else "float"))


def float_bits(col: Column, letter: str) -> Column:
    """What ``encode_float`` gives, where a UDF can't stand: within higher-order functions.

    The number is scaled to its exponent, so that exponent and fraction are whole numbers.
    """
    kind, exponent_bits, fraction_bits, width = FLOATS[letter]
    bias, full, least = (1 << (exponent_bits - 1)) - 1, (1 << exponent_bits) - 1, 2 - (1 << (exponent_bits - 1))

    def scaled(x: Column, e: Column) -> Column:
        """x * 2**-e in two steps, as 2**-e may be no double; exact but for subnormal results."""
        half = F.floor(e / 2)
        return x / F.pow(F.lit(2.0), half.cast("double")) / F.pow(F.lit(2.0), (e - half).cast("double"))

    def of_size(x: Column) -> Column:
        """x is not negative, finite and not 0."""
        guess = F.floor(F.log2(x)).cast("int")
        guess = F.greatest(F.lit(least), F.least(F.lit(bias), guess))

        def of_guess(e: Column) -> Column:
            m = scaled(x, e)
            right = F.when((m >= 2.0) & (e < bias), e + 1).when((m < 1.0) & (e > least), e - 1).otherwise(e)
            return _once(right, of_exponent)

        def of_exponent(e: Column) -> Column:
            whole = _once(scaled(x, e), lambda m: F.when(m >= 1.0, ((m - 1.0) * float(1 << fraction_bits)).cast("long") + F.shiftleft((e + bias).cast("long"), fraction_bits)).otherwise((m * float(1 << fraction_bits)).cast("long")))
            return whole

        return _once(guess, of_guess)

    def of_value(v: Column) -> Column:
        x = F.abs(v)
        size = (
            F.when(F.isnan(v), F.lit(full << fraction_bits | 1 << (fraction_bits - 1)).cast("long"))
            .when(x == float("inf"), F.lit(full << fraction_bits).cast("long"))
            .when(x == 0.0, F.lit(0).cast("long"))
            .otherwise(of_size(x))
        )
        minus = (v < 0.0) | (v.cast("string") == "-0.0")
        sign = F.when(minus, F.shiftleft(F.lit(1).cast("long"), 8 * width - 1)).otherwise(F.lit(0).cast("long"))
        return _once(size.bitwiseOR(sign), lambda b: _once(F.substring(F.lpad(F.hex(b), 16, "0"), 17 - 2 * width, 2 * width), lambda d: F.unhex(_swapped(d, width))))

    return F.when(col.isNotNull(), _once(col.cast(kind).cast("double"), of_value))


def encode(col: Column, letter: str) -> Column:
    """The bytes of a value by the letter of its format."""
    if letter in INTEGERS:
        return encode_integer(col, letter)
    if letter in FLOATS:
        return encode_float(col, letter)
    if letter == "s":
        return col.cast("binary")
    if letter == "x":
        return F.unhex(col)
    raise ValueError(f"no format letter: {letter!r}")


#: Fixed by the format: a variable-length integer takes 1 byte below 2**7, 2 below 2**13, 3 below 2**20, 4 below 2**27, else 5.
VARINT_BOUNDS = (1 << 7, 1 << 13, 1 << 20, 1 << 27)


def varint_length(col: Column) -> Column:
    """How many bytes an unsigned 32-bit integer takes."""
    out = F.when(col.isNull(), F.lit(None))
    for k, bound in enumerate(VARINT_BOUNDS):
        out = out.when(col < bound, k + 1)
    return out.otherwise(len(VARINT_BOUNDS) + 1).cast("int")


def _byte(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("long")), 2, "0")


def varint_encode(col: Column) -> Column:
    """An unsigned 32-bit integer: 6 bits in the first byte if more follow, 7 in each later one."""
    n = col.cast("long")
    more = F.lit(0x80).cast("long")
    shifts = (0, 6, 13, 20, 27)
    out = F.when(n.isNull(), F.lit(None)).when((n < 0) | (n >= 1 << 32), F.raise_error(F.lit("out of range for a variable-length integer")).cast("binary"))
    for k in range(5):
        bytes_ = [_byte(F.shiftright(n, s).bitwiseAND(0x3F if s == 0 else 0x7F).bitwiseOR(more)) for s in shifts[:k]]
        whole = F.unhex(F.concat(*bytes_, _byte(F.shiftright(n, shifts[k]))))
        out = out.when(n < VARINT_BOUNDS[k], whole) if k < 4 else out.otherwise(whole)
    return out


def varint_decode(col: Column) -> Column:
    """The integer at the start of some bytes."""

    def byte(k: int) -> Column:
        return F.conv(F.hex(F.substring(col, k + 1, 1)), 16, 10).cast("long")

    shifts = (0, 6, 13, 20, 27)
    value, out = F.lit(0).cast("long"), F.when(col.isNull(), F.lit(None))
    for k in range(5):
        out = out.when(F.octet_length(col) <= k, F.raise_error(F.lit("the bytes end within an integer")).cast("long"))
        b = byte(k)
        low = b.bitwiseAND(0x3F if k == 0 else 0x7F)
        last = value.bitwiseOR(F.shiftleft(b, shifts[k]))
        if k == 4:
            return out.when(b > 0x1F, F.raise_error(F.lit("integer out of range")).cast("long")).otherwise(last)
        out = out.when(b < 0x80, last)
        value = value.bitwiseOR(F.shiftleft(low, shifts[k]))
    raise AssertionError


def zigzag_encode(col: Column) -> Column:
    """A signed 32-bit integer as an unsigned one: small sizes of either sign stay small."""
    n = col.cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63)).bitwiseAND(F.lit(0xFFFFFFFF))


def zigzag_decode(col: Column) -> Column:
    n = col.cast("long")
    return F.shiftright(n, 1).bitwiseXOR(-n.bitwiseAND(1)).cast("int")
