"""Big-endian integers to and from BINARY columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pos(offset) -> Column:
    return (offset + 1) if isinstance(offset, Column) else F.lit(offset + 1)


def slice_bytes(data: Column, offset, width) -> Column:
    """``width`` bytes from the 0-based ``offset``; shorter at the end of the data."""
    return F.substr(data, _pos(offset), width if isinstance(width, Column) else F.lit(width))


def uint(data: Column, offset, width: int) -> Column:
    """Unsigned big-endian integer of 1 to 4 bytes; NULL where the data ends too early."""
    piece = slice_bytes(data, offset, width)
    number = F.conv(F.hex(piece), 16, 10)
    number = F.when(F.octet_length(piece) == width, number)
    return number.cast("int" if width <= 2 else "bigint")


def hex_uint(value: Column, width: int) -> Column:
    """Upper-case hex text of the low ``width`` bytes of an integer."""
    number = value.cast("bigint")
    if width > 7:
        return F.substring(F.lpad(F.hex(number), 16, "0"), 17 - 2 * width, 2 * width)
    # A bit above the bytes keeps their leading zeros.
    above = 1 << 8 * width
    return F.substring(F.hex(number.bitwiseAND(F.lit(above - 1).cast("bigint")) + F.lit(above).cast("bigint")), 2, 2 * width)


def uint_bytes(value: Column, width: int) -> Column:
    return F.unhex(hex_uint(value, width))
