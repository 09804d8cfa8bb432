"""DNS messages, packets and protobuf fields to bytes, all with built-in expressions.

Bytes are assembled as hex text and converted once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namestrata.functions.binary import hex_uint
from namestrata.functions.ip import ip_bytes
from namestrata.functions.once import let

CHARACTER = r"(\\[0-9]{3}|\\.|[^\\])"


def _hex_of_escaped(text: Column, keep_dots: bool) -> Column:
    """Hex of text with ``\\DDD`` and ``\\x`` escapes; unescaped dots stay when asked."""

    def one(token):
        decimal = F.conv(F.substring(token, 2, 3), 10, 16)
        plain = (
            F.when(F.length(token) == 4, F.lpad(decimal, 2, "0"))
            .when(F.length(token) == 2, F.hex(F.substring(token, 2, 1)))
            .otherwise(F.hex(token))
        )
        return F.when(token == ".", ".").otherwise(plain) if keep_dots else plain

    tokens = F.regexp_extract_all(text, F.lit(CHARACTER), F.lit(0))
    return F.array_join(F.transform(tokens, one), "")


def name_hex(name: Column) -> Column:
    """Uncompressed wire form of a name, as hex."""
    return let(name, _name_hex)


def _name_hex(name: Column) -> Column:
    escaped = F.split(_hex_of_escaped(name, keep_dots=True), r"\.")
    plain = F.transform(F.split(name, r"\."), lambda label: F.hex(label))
    labels = F.when(F.contains(name, F.lit("\\")), escaped).otherwise(plain)
    labels = F.filter(labels, lambda x: x != "")
    sized = F.transform(labels, lambda x: F.concat(_half_hex(x), x))
    return F.concat(F.array_join(sized, ""), F.lit("00"))


def _half_hex(digits: Column) -> Column:
    """The size of what ``digits`` stand for, as one byte of hex."""
    return F.lpad(F.hex(F.shiftright(F.length(digits), 1)), 2, "0")


def _field(words: Column, position: int) -> Column:
    return F.coalesce(F.get(words, F.lit(position)), F.lit(""))


def _number(words: Column, position: int, width: int) -> Column:
    return hex_uint(_field(words, position).try_cast("bigint"), width)


def rdata_hex(rrtype: Column, rdata: Column) -> Column:
    """Record data text back to hex; the generic form ``\\# length hex`` works for any type."""
    return let(F.split(rdata, " "), lambda words: _rdata_hex(rrtype, rdata, words))


def _rdata_hex(rrtype: Column, rdata: Column, words: Column) -> Column:
    quoted = F.regexp_extract_all(rdata, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))

    def sized(text):
        body = _hex_of_escaped(text, keep_dots=False)
        return let(body, lambda b: F.concat(F.lpad(F.hex((F.length(b) / 2).cast("bigint")), 2, "0"), b))

    strings = F.array_join(F.transform(quoted, sized), "")
    tag = F.hex(_field(words, 1))
    caa = F.concat(
        _number(words, 0, 1), F.lpad(F.hex((F.length(tag) / 2).cast("bigint")), 2, "0"), tag,
        F.hex(F.regexp_extract(rdata, '"(.*)"$', 1)),
    )
    soa = F.concat(
        name_hex(_field(words, 0)), name_hex(_field(words, 1)),
        *[_number(words, i, 4) for i in range(2, 7)],
    )
    return (
        F.when(F.coalesce(rdata, F.lit("")) == "", F.lit(""))
        .when(F.startswith(rdata, F.lit("\\# ")), F.coalesce(F.get(words, F.lit(2)), F.lit("")))
        .when(rrtype.isin(1, 28), F.hex(ip_bytes(rdata)))
        .when(rrtype.isin(2, 5, 12, 39), name_hex(rdata))
        .when(rrtype == 15, F.concat(_number(words, 0, 2), name_hex(_field(words, 1))))
        .when(rrtype == 33, F.concat(*[_number(words, i, 2) for i in range(3)], name_hex(_field(words, 3))))
        .when(rrtype == 6, soa)
        .when(rrtype.isin(16, 99), strings)
        .when(rrtype == 257, caa)
    )


def _section(records: Column) -> Column:
    def one(r):
        data = let(
            rdata_hex(r["rrtype"], r["rdata"]),
            lambda d: F.concat(hex_uint((F.length(d) / 2).cast("bigint"), 2), d),
        )
        return F.concat(
            name_hex(r["name"]), hex_uint(r["rrtype"], 2), hex_uint(r["class"], 2),
            hex_uint(r["ttl"], 4), data,
        )

    return F.coalesce(F.array_join(F.transform(records, one), ""), F.lit(""))


def message_bytes(dns: Column) -> Column:
    """Wire form of a message struct (names uncompressed)."""
    flag_bits = [
        ("response", 0x8000), ("authoritative", 0x400), ("truncated", 0x200),
        ("recursion_desired", 0x100), ("recursion_available", 0x80), ("zero", 0x40),
        ("authenticated_data", 0x20), ("checking_disabled", 0x10),
    ]
    flags = F.shiftleft(dns["opcode"].bitwiseAND(15), 11).bitwiseOR(dns["rcode"].bitwiseAND(15))
    for name, mask in flag_bits:
        flags = flags.bitwiseOR(F.when(dns[name], mask).otherwise(0))
    counts = [
        hex_uint(F.greatest(F.size(F.coalesce(dns[s], F.array())), F.lit(0)), 2)
        for s in ("question", "answer", "ns", "extra")
    ]
    questions = F.transform(
        dns["question"],
        lambda q: F.concat(name_hex(q["name"]), hex_uint(q["qtype"], 2), hex_uint(q["qclass"], 2)),
    )
    return F.unhex(
        F.concat(
            hex_uint(dns["id"], 2), hex_uint(flags, 2), *counts,
            F.coalesce(F.array_join(questions, ""), F.lit("")),
            *[_section(dns[s]) for s in ("answer", "ns", "extra")],
        )
    )


# --- packets ---------------------------------------------------------------------------------


def udp_hex(src_port: Column, dst_port: Column, payload: Column) -> Column:
    size = F.octet_length(payload) + 8
    return F.concat(
        hex_uint(src_port, 2), hex_uint(dst_port, 2), hex_uint(size, 2), F.lit("0000"),
        F.hex(payload),
    )


def tcp_hex(src_port: Column, dst_port: Column, seq: Column, flags: Column, payload_hex: Column) -> Column:
    return F.concat(
        hex_uint(src_port, 2), hex_uint(dst_port, 2), hex_uint(seq, 4), F.lit("00000000"),
        F.lit("50"), hex_uint(flags, 1), F.lit("FFFF00000000"), payload_hex,
    )


def ip_hex(
    src: Column, dst: Column, protocol: Column, body_hex: Column,
    ip_id: Column | None = None, flags_offset: Column | None = None,
) -> Column:
    """An IPv4 or IPv6 header in front of ``body_hex``; the family follows the addresses."""
    return let(body_hex, lambda body: ip_hex_of(src, dst, protocol, body, ip_id, flags_offset))


def ip_hex_of(
    src: Column, dst: Column, protocol: Column, body_hex: Column,
    ip_id: Column | None = None, flags_offset: Column | None = None,
) -> Column:
    """The same for a body that is a column of its own and costs nothing to name twice."""
    size = F.shiftright(F.length(body_hex), 1)
    zero = F.lit(0)
    v4 = F.concat(
        F.lit("4500"), hex_uint(size + 20, 2), hex_uint(zero if ip_id is None else ip_id, 2),
        hex_uint(zero if flags_offset is None else flags_offset, 2), F.lit("40"),
        hex_uint(protocol, 1), F.lit("0000"), F.hex(src), F.hex(dst), body_hex,
    )
    v6 = F.concat(
        F.lit("60000000"), hex_uint(size, 2), hex_uint(protocol, 1), F.lit("40"),
        F.hex(src), F.hex(dst), body_hex,
    )
    return F.when(F.octet_length(src) == 4, v4).otherwise(v6)


def ethernet_hex(src: Column, inner_hex: Column, vlans: tuple[int, ...] = ()) -> Column:
    """An Ethernet header with optional VLAN tags in front of an IP packet."""
    tags = "".join(f"8100{v:04X}" for v in vlans)
    ethertype = F.when(F.octet_length(src) == 4, "0800").otherwise("86DD")
    return F.concat(F.lit("020000000001020000000002" + tags), ethertype, inner_hex)


def vxlan_hex(outer_src: Column, outer_dst: Column, frame_hex: Column) -> Column:
    """A frame inside UDP/VXLAN inside IP (without the outer Ethernet header)."""
    body = F.concat(F.lit("0800000000000100"), frame_hex)
    size = (F.length(body) / 2).cast("bigint") + 8
    udp = F.concat(F.lit("C00012B5"), hex_uint(size, 2), F.lit("0000"), body)
    return ip_hex(outer_src, outer_dst, F.lit(17), udp)


# --- protobuf --------------------------------------------------------------------------------


def varint_hex(value: Column, most: int = 10) -> Column:
    """Protobuf varint of a non-negative BIGINT in at most ``most`` bytes."""
    return let(value.cast("bigint"), lambda v: _varint_hex(v, most))


def _varint_hex(value: Column, most: int) -> Column:
    parts = []
    for i in range(most):
        rest = F.shiftrightunsigned(value, 7 * i)
        byte = rest.bitwiseAND(F.lit(0x7F).cast("bigint"))
        more = F.shiftrightunsigned(value, 7 * (i + 1)) != 0 if i < 9 else F.lit(False)
        byte = F.when(more, byte.bitwiseOR(F.lit(0x80).cast("bigint"))).otherwise(byte)
        shown = F.lit(True) if i == 0 else rest != 0
        parts.append(F.when(shown, hex_uint(byte, 1)).otherwise(""))
    return F.concat(*parts)


def _tag(number: int, kind: int) -> str:
    value, out = number << 3 | kind, b""
    while value > 0x7F:
        out += bytes([value & 0x7F | 0x80])
        value >>= 7
    return (out + bytes([value])).hex().upper()


def proto_int(number: int, value: Column, most: int = 5, always: bool = False) -> Column:
    """Integer field; left out when zero or NULL unless ``always``."""
    field = F.concat(F.lit(_tag(number, 0)), varint_hex(value, most))
    shown = value.isNotNull() if always else F.coalesce(value != 0, F.lit(False))
    return F.when(shown, field).otherwise("")


def proto_fixed32(number: int, value: Column) -> Column:
    big = hex_uint(value, 4)
    little = F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)])
    return F.when(value.isNotNull(), F.concat(F.lit(_tag(number, 5)), little)).otherwise("")


def proto_bytes(number: int, value_hex: Column, always: bool = False) -> Column:
    """Length-delimited field from hex; left out when empty or NULL unless ``always``."""

    def field(data: Column) -> Column:
        size = (F.length(data) / 2).cast("bigint")
        shown = data.isNotNull() if always else F.coalesce(size > 0, F.lit(False))
        return F.when(shown, F.concat(F.lit(_tag(number, 2)), varint_hex(size, 4), data)).otherwise("")

    return let(value_hex, field)
