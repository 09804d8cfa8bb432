"""IP addresses as BINARY(4) or BINARY(16), all with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namestrata.functions.binary import hex_uint
from namestrata.functions.once import let

MAPPED_PREFIX = "00000000000000000000FFFF"


def _half(hexa: Column, first: int) -> Column:
    """Signed 64-bit value of 16 hex digits starting at the 1-based digit ``first``."""
    return F.conv(F.substring(hexa, first, 16), 16, -10).cast("bigint")


def _mask64(bits: int) -> int:
    """Signed 64-bit mask with ``bits`` leading ones."""
    bits = max(0, min(64, bits))
    value = ((1 << bits) - 1) << (64 - bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def check_mask(bits: int, width: int) -> int:
    if not 0 <= bits <= width:
        raise ValueError(f"mask size {bits} is outside 0..{width}")
    return bits


def mask_ip(ip: Column, v4_bits: int = 32, v6_bits: int = 128) -> Column:
    """Zero the host part of an address; the family follows from the byte length."""
    return let(ip, lambda address: mask_ip_of(address, v4_bits, v6_bits))


def mask_ip_of(ip: Column, v4_bits: int = 32, v6_bits: int = 128) -> Column:
    """The same for an address that is a column of its own and costs nothing to name often."""
    check_mask(v4_bits, 32)
    check_mask(v6_bits, 128)
    v4 = ip
    if v4_bits < 32:
        number = F.conv(F.hex(ip), 16, 10).cast("bigint")
        v4 = F.unhex(hex_uint(number.bitwiseAND(F.lit(_mask64(32 + v4_bits) & 0xFFFFFFFF)), 4))
    v6 = ip
    if v6_bits < 128:
        hexa = F.hex(ip)
        high = _half(hexa, 1).bitwiseAND(F.lit(_mask64(v6_bits)))
        low = _half(hexa, 17).bitwiseAND(F.lit(_mask64(v6_bits - 64)))
        v6 = F.unhex(F.concat(hex_uint(high, 8), hex_uint(low, 8)))
    size = F.octet_length(ip)
    return F.when(size == 4, v4).when(size == 16, v6)


def to_16(ip: Column) -> Column:
    """16-byte form; IPv4 becomes the mapped address ``::ffff:a.b.c.d``."""
    mapped = F.concat(F.unhex(F.lit(MAPPED_PREFIX)), ip)
    return F.when(F.octet_length(ip) == 4, mapped).when(F.octet_length(ip) == 16, ip)


def to_number(ip: Column) -> Column:
    """IPv4 as its 32-bit number, IPv6 as the number in its first 8 bytes."""
    return F.conv(F.hex(F.substring(ip, 1, 8)), 16, 10).cast("decimal(20,0)")


def _v4_text(hexa: Column, first: int) -> Column:
    parts = [F.conv(F.substring(hexa, first + 2 * i, 2), 16, 10) for i in range(4)]
    return F.concat_ws(".", *parts)


def _v6_text(hexa: Column) -> Column:
    groups = [F.regexp_replace(F.substring(hexa, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)]
    return let(F.lower(F.concat(F.lit(":"), F.concat_ws(":", *groups), F.lit(":"))), _shorten)


def _shorten(flat: Column) -> Column:
    # The longest run of two or more zero groups shrinks to "::", the leftmost on a tie.
    short = flat
    for length in range(2, 9):
        run = ":" + "0:" * length
        at = F.locate(run, flat)
        cut = F.concat(
            F.substring(flat, F.lit(1), at - 1),
            F.lit("::"),
            F.substring(flat, at + len(run), F.lit(64)),
        )
        short = F.when(at > 0, cut).otherwise(short)
    return F.regexp_replace(short, "^:(?!:)|(?<!:):$", "")


def ip_text(ip: Column) -> Column:
    """Usual text form; mapped addresses print as dotted IPv4."""

    return let(F.hex(ip), lambda hexa: _hex_text(hexa, F.length(hexa)))


def ip_text_of(ip: Column) -> Column:
    """The same for an address that is a column of its own and costs nothing to name often."""
    return _hex_text(F.hex(ip), F.octet_length(ip) * 2)


def _hex_text(hexa: Column, digits: Column) -> Column:
    return (
        F.when(digits == 8, _v4_text(hexa, 1))
        .when((digits == 32) & hexa.startswith(MAPPED_PREFIX), _v4_text(hexa, 25))
        .when(digits == 32, _v6_text(hexa))
    )


def _v4_hex(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return F.concat(*[hex_uint(F.try_element_at(parts, F.lit(i + 1)), 1) for i in range(4)])


def _groups_hex(text: Column) -> Column:
    groups = F.filter(F.split(text, ":"), lambda g: g != "")
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.upper(g), 4, "0")), "")


def ip_bytes(text: Column) -> Column:
    """Parse dotted IPv4 or colon IPv6 text (``::`` allowed) to bytes."""

    def v6(t: Column) -> Column:
        sides = F.transform(F.split(t, "::"), _groups_hex)

        def filled(s: Column) -> Column:
            left, right = F.get(s, F.lit(0)), F.get(s, F.lit(1))
            zeros = F.repeat(F.lit("0"), F.lit(32) - F.length(left) - F.length(right))
            return F.when(F.size(s) == 2, F.concat(left, zeros, right)).otherwise(left)

        return let(sides, filled)

    return let(text, lambda t: F.unhex(F.when(F.contains(t, F.lit(":")), v6(t)).otherwise(_v4_hex(t))))
