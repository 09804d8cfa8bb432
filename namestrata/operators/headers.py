"""Link, IP and transport headers, read for all packets of an Arrow batch at once.

numpy reads a number of every packet in one step, so there is no loop over packets and nothing is copied
but addresses and payloads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namestrata.functions.arrow_steps import keep, pick, then
from namestrata.functions.byte_rows import ByteRows, numbers
from namestrata.operators.counters import Counters, watched
from namestrata.schemas import LINK_ETHERNET

UDP, TCP, V6_FRAGMENT, HOP_BY_HOP = 17, 6, 44, 0
VXLAN_PORT = 4789
CARRIED = ["file", "seq", "ts", "ts_ns"]


ERRORS = ["empty packet", "not an IP packet", "truncated IP header", "bad header length", "bad IP length"]
IP_FIELDS = (
    "ip_version INT, src_ip BINARY, dst_ip BINARY, protocol_no INT, ip_id BIGINT, frag_offset INT, "
    "more_fragments BOOLEAN, is_fragment BOOLEAN, payload BINARY, error STRING"
)


def _tags(rows: ByteRows, where: np.ndarray) -> np.ndarray:
    """How many 802.1q tags lie behind the addresses, at any depth; the first four bytes that are no tag end them."""
    found = np.zeros(len(where), np.int64)
    live = where
    while live.any():
        kind, there = rows.uint(12 + 4 * found, 2)
        live = live & there & np.isin(kind, (0x8100, 0x88A8))
        found += live
    return found


def _ethernet_family(rows: ByteRows, l3: np.ndarray) -> np.ndarray:
    kind, there = rows.uint(l3 - 2, 2)
    return np.where(there & (kind == 0x0800), 4, np.where(there & (kind == 0x86DD), 6, 0))


def _layer3(rows: ByteRows, ethernet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the IP header begins, and its family (4, 6 or 0).

    Without an Ethernet header the first nibble tells the family.
    """
    l3 = np.where(ethernet, _tags(rows, ethernet) * 4 + 14, 0)
    first, there = rows.uint(0, 1)
    raw = np.where(there & np.isin(first >> 4, (4, 6)), first >> 4, 0)
    return l3, np.where(ethernet, _ethernet_family(rows, np.maximum(l3, 2)), raw)


def _unwrap_vxlan(rows: ByteRows, l3: np.ndarray, family: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move VXLAN packets on to the Ethernet frame they carry.

    The port alone does not make a VXLAN packet: it may be an ordinary client port. The frame
    inside must also carry IP, possibly behind VLAN tags. Other packets keep what was read of them.
    """
    first, begun = rows.uint(l3, 1)
    l4 = l3 + np.where(family == 4, (first & 15) * 4, 40)
    protocol, _ = rows.uint(l3 + np.where(family == 4, 9, 6), 1)
    port, _ = rows.uint(l4 + 2, 2)
    carried, there = rows.uint(l4 + 28, 2)
    # What lies that far in a packet has all that comes before it.
    wrapped = (family > 0) & begun & there & (port == VXLAN_PORT) & (protocol == UDP)
    wrapped &= np.isin(carried, (0x0800, 0x86DD, 0x8100, 0x88A8))
    if not wrapped.any():
        return l3, family
    rows.start = np.where(wrapped, rows.start + l4 + 16, rows.start)
    l3 = np.where(wrapped, _tags(rows, wrapped) * 4 + 14, l3)
    return l3, np.where(wrapped, _ethernet_family(rows, np.maximum(l3, 2)), family)


def _ip_fields(rows: ByteRows, ethernet: np.ndarray, vxlan: bool) -> list[pa.Array]:
    """IP_FIELDS of every packet. Each number comes with where it is known: headers may end anywhere."""
    l3, family = _layer3(rows, ethernet)
    if vxlan:
        l3, family = _unwrap_vxlan(rows, l3, family)
    v4, v6, size = family == 4, family == 6, rows.size
    first, begun = rows.uint(l3, 1)
    ihl, sized = np.where(v4, (first & 15) * 4, 40), ~v4 | begun
    length, measured = rows.uint(l3 + np.where(v4, 2, 4), 2)
    length, measured = length + np.where(v6, 40, 0), measured & (family > 0)
    following, named = rows.uint(l3 + np.where(v4, 9, 6), 1)
    named &= family > 0
    # A hop-by-hop header belongs to the IPv6 header proper.
    hop = v6 & named & (following == HOP_BY_HOP)
    if hop.any():
        inner, inner_there = rows.uint(l3 + 40, 1)
        words, words_there = rows.uint(l3 + 41, 1)
        ihl, sized = np.where(hop, words * 8 + 48, ihl), np.where(hop, words_there, sized)
        following, named = np.where(hop, inner, following), np.where(hop, inner_there, named)
    l4 = l3 + ihl
    fragmented6 = v6 & named & (following == V6_FRAGMENT)
    flags, flagged = rows.uint(np.where(v4, l3 + 6, l4 + 2), 2)
    flagged &= v4 | (fragmented6 & sized)
    id4, id4_there = rows.uint(l3 + 4, 2)
    id6, id6_there = rows.uint(l4 + 4, 4)
    inside, inside_there = rows.uint(l4, 1)
    protocol = np.where(fragmented6, inside, following)
    protocol_known = np.where(fragmented6, inside_there & sized, named)
    skipped = np.where(fragmented6, 8, 0)
    width = np.where(measured, np.maximum(0, length - ihl - skipped), 0)
    offset4, more4 = flags & 0x1FFF, flags & 0x2000 != 0
    cut4 = v4 & flagged & (flags & 0x4000 == 0) & (more4 | (offset4 != 0))
    offset = np.where(v4, offset4, np.where(fragmented6, flags >> 3, 0))
    more = np.where(v4, more4, fragmented6 & (flags & 1 != 0))
    wrong = np.select(
        [
            rows.known & (size == 0), family == 0, sized & (size < l3 + ihl), sized & (ihl < 20),
            ~measured | (sized & (length < ihl)),
        ],
        range(len(ERRORS)), -1,
    )
    every = np.ones(len(family), bool)
    error = pa.DictionaryArray.from_arrays(numbers(wrong, wrong >= 0, pa.int32()), ERRORS).cast(pa.string())
    return [
        numbers(family, family > 0, pa.int32()),
        rows.pieces(l3 + np.where(v4, 12, 8), np.where(v4, 4, 16), family > 0),
        rows.pieces(l3 + np.where(v4, 16, 24), np.where(v4, 4, 16), family > 0),
        numbers(protocol, protocol_known, pa.int32()),
        numbers(np.where(v4, id4, id6), (v4 & id4_there) | (fragmented6 & sized & id6_there), pa.int64()),
        numbers(np.where(flagged, offset, 0), every, pa.int32()),
        pa.array(flagged & more),
        pa.array(fragmented6 | cut4, pa.bool_(), mask=(v4 & ~flagged) | ~(v4 | v6) | (v6 & ~named)),
        rows.pieces(l4 + skipped, width, sized & rows.known),
        error,
    ]


def ip_datagrams(
    packets: DataFrame, ethernet: bool | None = None, vxlan: bool = True
) -> DataFrame:
    """IP header fields and payload of each packet.

    ``ethernet`` forces the link layer; None follows ``link_type``. ``error`` tells why a
    row could not be decoded; such rows keep NULL fields and can be counted or filtered.
    """
    rows = pick(packets, [*CARRIED, *([] if ethernet is not None else ["link_type"]), "data"])
    fields = T.DataType.fromDDL(f"STRUCT<{IP_FIELDS}>").fields
    schema = T.StructType([*[rows.schema[c] for c in CARRIED], *fields])
    names = schema.names

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if ethernet is None:
                framed = pc.equal(batch.column("link_type"), LINK_ETHERNET).fill_null(False)
                framed = np.asarray(framed.to_numpy(zero_copy_only=False), dtype=bool)
            else:
                framed = np.full(batch.num_rows, ethernet)
            made = _ip_fields(ByteRows(batch.column("data")), framed, vxlan)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in CARRIED], *made], names=names)

    return then(rows, job, schema)


def default_traffic(datagrams: DataFrame) -> DataFrame:
    """The capture's default filter: IPv4 TCP or UDP; IPv6 UDP, TCP or fragments."""
    plain = F.col("protocol_no").isin(UDP, TCP)
    return datagrams.filter(plain | ((F.col("ip_version") == 6) & F.col("is_fragment")))


TRANSPORT_FIELDS = (
    "src_port INT, dst_port INT, udp_length INT, tcp_seq BIGINT, tcp_header INT, tcp_flags INT, "
    "transport_ok BOOLEAN, payload BINARY"
)


def _transport_fields(rows: ByteRows, protocol: np.ndarray) -> list[pa.Array]:
    udp, tcp, size = protocol == UDP, protocol == TCP, rows.size
    src, src_there = rows.uint(0, 2)
    dst, dst_there = rows.uint(2, 2)
    length, length_there = rows.uint(4, 2)
    number, number_there = rows.uint(4, 4)
    words, words_there = rows.uint(12, 1)
    flags, flags_there = rows.uint(13, 1)
    header = (words >> 4) * 4
    whole = (udp & length_there & ((length >= 8) | (length == 0))) | (
        tcp & words_there & (header >= 20) & (header <= size)
    )
    whole &= dst_there
    skipped = np.where(whole, np.where(udp, 8, header), 0)
    width = np.where(whole & udp & (length > 0), length - 8, size)
    return [
        numbers(src, (udp | tcp) & src_there, pa.int32()),
        numbers(dst, (udp | tcp) & dst_there, pa.int32()),
        numbers(length, udp & length_there, pa.int32()),
        numbers(number, tcp & number_there, pa.int64()),
        numbers(header, tcp & words_there, pa.int32()),
        numbers(flags, tcp & flags_there, pa.int32()),
        pa.array(whole),
        rows.pieces(skipped, width, rows.known),
    ]


def transport_fields(datagrams: DataFrame) -> DataFrame:
    """UDP and TCP header fields of every row, and ``transport_ok``: whether they are whole.

    ``payload`` becomes the body where they are. Rows of other protocols are not ok.
    """
    fields = T.DataType.fromDDL(f"STRUCT<{TRANSPORT_FIELDS}>").fields
    made = [f.name for f in fields]
    kept = [c for c in datagrams.columns if c not in made]
    schema = T.StructType([*[datagrams.schema[c] for c in kept], *fields])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            protocol = np.asarray(batch.column("protocol_no").fill_null(-1))
            found = _transport_fields(ByteRows(batch.column("payload")), protocol)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *found], names=[*kept, *made])

    return then(pick(datagrams, [*kept, "payload"]), job, schema)


def transport(datagrams: DataFrame, counters: Counters | None = None) -> DataFrame:
    """UDP and TCP header fields of unfragmented or reassembled datagrams."""
    known = keep(
        datagrams, F.col("protocol_no").isin(UDP, TCP),
        lambda b: pc.is_in(b.column("protocol_no"), pa.array([UDP, TCP], pa.int32())),
    )
    rows = watched(counters, transport_fields(known), decodingErrors=~F.col("transport_ok"))
    rows = keep(rows, F.col("transport_ok"), lambda b: b.column("transport_ok"))
    return pick(rows, [c for c in rows.columns if c not in ("udp_length", "tcp_header", "transport_ok")])


def with_layer_errors(datagrams: DataFrame) -> DataFrame:
    """Header fields of every row with ``layer_error``: the IP error, or a broken UDP or TCP header."""
    rows = transport_fields(datagrams)
    broken = F.col("protocol_no").isin(UDP, TCP) & ~F.col("is_fragment") & ~F.col("transport_ok")
    error = F.coalesce("error", F.when(broken, "bad transport header"))
    return rows.withColumn("layer_error", error).drop("udp_length", "tcp_header", "transport_ok", "error")


def on_port(df: DataFrame, port: int = 53) -> DataFrame:
    """Traffic from or to ``port``."""
    if not 1 <= port <= 65535:
        raise ValueError("the port must be between 1 and 65535")
    return keep(
        df, (F.col("src_port") == port) | (F.col("dst_port") == port),
        lambda b: pc.or_kleene(pc.equal(b.column("src_port"), port), pc.equal(b.column("dst_port"), port)),
    )


def port_range(df: DataFrame, low: int, high: int, column: str = "src_port") -> DataFrame:
    """A slice of the traffic by port range, to split work between jobs."""
    return df.filter(F.col(column).between(low, high))
