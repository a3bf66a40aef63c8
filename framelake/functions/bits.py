"""Integers, bit fields and variable-length sizes inside BINARY columns, as column expressions.

Places count bytes or bits from 0.  What lies beyond the end of the data is
null, never an error, so a damaged row does not end a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _place(at: Column | int) -> Column:
    return F.lit(at).cast("int") if isinstance(at, int) else at.cast("int")


def hex_at(data: Column, at: Column | int, n: int) -> Column:
    """Hexadecimal digits of ``n`` bytes, or null where they are not all there."""
    at = _place(at)
    digits = F.hex(F.substring(data, at + 1, F.lit(n)))
    return F.when((at >= 0) & (F.octet_length(data) >= at + n), digits)


def big_endian(data: Column, at: Column | int, n: int) -> Column:
    """Unsigned integer of up to 7 bytes, most significant first."""
    return F.conv(hex_at(data, at, n), 16, 10).cast("long")


def little_endian(data: Column, at: Column | int, n: int) -> Column:
    """Unsigned integer of up to 8 bytes, least significant first; DECIMAL(20,0) for 8."""
    digits = hex_at(data, at, n)
    turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])
    value = F.conv(turned, 16, 10)
    return value.cast("decimal(20,0)" if n == 8 else "long")


def signed_16(data: Column, at: Column | int) -> Column:
    """Two's complement of two bytes, most significant first."""
    value = big_endian(data, at, 2)
    return value - F.when(value >= 1 << 15, 1 << 16).otherwise(0)


def ascii_at(data: Column, at: Column | int, n: int) -> Column:
    """Characters of ``n`` bytes, one for each."""
    return F.decode(F.unhex(hex_at(data, at, n)), "ISO-8859-1")


def field(data: Column, bit: Column | int, n: int) -> Column:
    """Unsigned field of ``n`` bits (32 at most), most significant first."""
    bit = F.lit(bit) if isinstance(bit, int) else bit
    bit = bit.cast("long")
    first = F.floor(bit / 8).cast("int")
    shift = F.lit(40 - n) - (bit % 8)
    wide = F.conv(F.rpad(F.hex(F.substring(data, first + 1, F.lit(5))), 10, "0"), 16, 10).cast("long")
    value = F.floor(wide / F.pow(F.lit(2.0), shift)).cast("long").bitwiseAND(F.lit((1 << n) - 1))
    return F.when((bit >= 0) & (bit + n <= 8 * F.octet_length(data).cast("long")), value)


def signed_field(data: Column, bit: Column | int, n: int) -> Column:
    """``n`` bits of magnitude and one of sign after them."""
    after = (F.lit(bit) if isinstance(bit, int) else bit) + n
    size = field(data, bit, n)
    return F.when(field(data, after, 1) == 1, -size).otherwise(F.when(field(data, after, 1) == 0, size))


def vint(data: Column, at: Column | int, identifier: bool = False) -> Column:
    """Struct (value, width, unknown) of a variable-length integer, or null if it is damaged.

    The leading zeros of the first byte tell the width.  Identifiers keep their
    marker bit and have 4 bytes at most; sizes drop it, have 8 at most, and are
    unknown where all remaining bits are set.
    """
    at = _place(at)
    first = big_endian(data, at, 1)
    width = (8 - F.floor(F.log2(F.nullif(first, F.lit(0)).cast("double")))).cast("int")
    digits = F.hex(F.substring(data, at + 1, width))
    whole = F.conv(digits, 16, 10).cast("decimal(20,0)").cast("long")
    marker = F.pow(F.lit(2.0), 7 * width).cast("long")
    value = whole if identifier else whole - marker
    fine = (first > 0) & (F.octet_length(data) >= at + width) & (width <= (4 if identifier else 8))
    unknown = F.lit(False) if identifier else value == marker - 1
    return F.when(fine, F.struct(value.alias("value"), width.alias("width"), unknown.alias("unknown")))
