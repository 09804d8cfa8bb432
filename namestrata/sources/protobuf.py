"""Protobuf fields of a whole Arrow batch, and the two record types built on them.

Every message keeps a cursor; each step reads one field of all messages at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from namestrata.schemas import DNS_RESULT_COLUMNS
from namestrata.sources.dns_wire import Buffer, _gather, _join_bytes, decode_messages

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def read_varints(buf: Buffer, at: np.ndarray, end: np.ndarray):
    """(ok, value as uint64, position after) for a varint at every position."""
    n = len(at)
    value = np.zeros(n, dtype=np.uint64)
    cursor, ok = at.copy(), np.ones(n, dtype=bool)
    live = np.arange(n)
    for step in range(10):
        inside = cursor[live] < end[live]
        ok[live[~inside]] = False
        live = live[inside]
        byte = buf.read(cursor[live], 1)
        value[live] |= (byte & 0x7F).astype(np.uint64) << np.uint64(7 * step)
        cursor[live] += 1
        live = live[(byte & 0x80) != 0]
        if not len(live):
            return ok, value, cursor
    ok[live] = False
    return ok, value, cursor


def little_endian(buf: Buffer, at: np.ndarray, width: int) -> np.ndarray:
    value = np.zeros(len(at), dtype=np.uint64)
    at = np.minimum(at, len(buf.data) - width)
    for i in range(width):
        value |= buf.data[at + i].astype(np.uint64) << np.uint64(8 * i)
    return value


class Fields:
    """Last value of each wanted field per message.

    ``value`` holds numbers, ``at`` and ``size`` the span of length-delimited data, ``has``
    whether the field occurs.
    """

    def __init__(self, buf: Buffer, begin: np.ndarray, end: np.ndarray, numbers: tuple[int, ...]):
        n = len(begin)
        self.buf, self.ok = buf, np.ones(n, dtype=bool)
        self.has = {f: np.zeros(n, dtype=bool) for f in numbers}
        self.value = {f: np.zeros(n, dtype=np.uint64) for f in numbers}
        self.at = {f: np.zeros(n, dtype=np.int64) for f in numbers}
        self.size = {f: np.zeros(n, dtype=np.int64) for f in numbers}
        cursor = begin.copy()
        while True:
            live = np.flatnonzero(self.ok & (cursor < end))
            if not len(live):
                break
            good, tag, after = read_varints(buf, cursor[live], end[live])
            kind, number = (tag & np.uint64(7)).astype(int), (tag >> np.uint64(3)).astype(np.int64)
            good2, value, after_value = read_varints(buf, after, end[live])
            start, size = after.copy(), np.zeros(len(live), dtype=np.int64)
            numeric = kind == VARINT
            data = kind == BYTES
            good &= np.where(numeric | data, good2, True)
            start[data], size[data] = after_value[data], value[data].astype(np.int64)
            for fixed, width in ((FIXED32, 4), (FIXED64, 8)):
                mine = kind == fixed
                value[mine] = little_endian(buf, after[mine], width)
                size[mine] = width
            following = np.where(numeric, after_value, start + size)
            good &= np.isin(kind, (VARINT, FIXED64, BYTES, FIXED32)) & (number > 0)
            good &= (size >= 0) & (following <= end[live])
            self.ok[live[~good]] = False
            for field in self.has:
                mine = good & (number == field)
                rows = live[mine]
                self.has[field][rows] = True
                self.value[field][rows] = value[mine]
                self.at[field][rows] = start[mine]
                self.size[field][rows] = size[mine]
            cursor[live] = np.where(good, following, end[live])

    def numbers(self, field: int, dtype=np.int64) -> np.ndarray:
        return self.value[field].astype(dtype)

    def data(self, field: int, where: np.ndarray | None = None) -> pa.Array:
        """Field bytes; empty where the field is missing."""
        at, size = self.at[field], self.size[field]
        if where is not None:
            at, size = at[where], size[where]
        return _join_bytes(_gather(self.buf.data, at, size), size, pa.binary())

    def text(self, field: int, where: np.ndarray | None = None) -> pa.Array:
        raw = self.data(field, where)
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([v.as_py().decode("utf-8", "replace") for v in raw], pa.string())


def map_records(df: DataFrame, column: str, parse, schema: T.StructType, carried: list[str]) -> DataFrame:
    """Run a batch parser over one BINARY column; ``carried`` columns pass through."""
    fields = [df.schema[c] for c in carried]
    full = T.StructType([*fields, *schema.fields])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = parse(batch.column(column))
            arrays = [*(batch.column(c) for c in carried), *arrays]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in full.fields])

    return df.select(*dict.fromkeys([*carried, column])).mapInArrow(job, full)


# --- dnstap ----------------------------------------------------------------------------------

# Dnstap field numbers and socket protocols.
IDENTITY, VERSION, MESSAGE = 1, 2, 14
FAMILY, PROTOCOL, QUERY_ADDRESS, RESPONSE_ADDRESS, QUERY_PORT, RESPONSE_PORT = 2, 3, 4, 5, 6, 7
QUERY_SEC, QUERY_NSEC, QUERY_DATA, RESPONSE_SEC, RESPONSE_NSEC, RESPONSE_DATA = 8, 9, 10, 12, 13, 14
PROTOCOLS = {1: "udp", 2: "tcp", 3: "dot", 4: "doh", 5: "dnscryptudp", 6: "dnscrypttcp", 7: "doq"}

_EVENT = (
    "ts TIMESTAMP, ts_ns BIGINT, ip_version INT, src_ip BINARY, src_port INT, dst_ip BINARY, "
    "dst_port INT, protocol STRING, packet_length INT, identity STRING, version STRING, "
)


def _stamp(ns: np.ndarray) -> pa.Array:
    return pa.array(ns // 1000).cast(pa.timestamp("us", tz="UTC"))


def _parse_dnstap(column: pa.Array) -> list[pa.Array]:
    buf = Buffer(column)
    outer = Fields(buf, buf.begin, buf.end, (IDENTITY, VERSION, MESSAGE))
    begin = np.where(outer.has[MESSAGE], outer.at[MESSAGE], 0)
    inner = Fields(
        buf, begin, begin + outer.size[MESSAGE],
        (FAMILY, PROTOCOL, QUERY_ADDRESS, RESPONSE_ADDRESS, QUERY_PORT, RESPONSE_PORT, QUERY_SEC,
         QUERY_NSEC, QUERY_DATA, RESPONSE_SEC, RESPONSE_NSEC, RESPONSE_DATA),
    )
    valid = outer.ok & inner.ok & outer.has[MESSAGE] & inner.has[FAMILY]
    # The query counts when there is one, with its own time; otherwise the response.
    asked = inner.has[QUERY_DATA]

    def either(values, query, response):
        return np.where(asked, values[query], values[response])

    seconds = either(inner.value, QUERY_SEC, RESPONSE_SEC).astype(np.int64)
    ns = seconds * 1_000_000_000 + either(inner.value, QUERY_NSEC, RESPONSE_NSEC).astype(np.int64)
    at, size = either(inner.at, QUERY_DATA, RESPONSE_DATA), either(inner.size, QUERY_DATA, RESPONSE_DATA)
    wire = _join_bytes(_gather(buf.data, at, size), size, pa.binary())
    message, error = decode_messages(wire)
    known = inner.numbers(PROTOCOL)
    protocol = pa.array([PROTOCOLS.get(int(p), "") for p in known], pa.string())
    reasons = [
        "invalid frame" if not v else e for v, e in zip(valid, error.to_pylist())
    ]

    def i32(x):
        return pa.array(x.astype(np.int32))

    return [
        _stamp(ns), pa.array(ns), i32(inner.numbers(FAMILY) * 2 + 2),
        inner.data(QUERY_ADDRESS), i32(inner.numbers(QUERY_PORT) & 0xFFFF),
        inner.data(RESPONSE_ADDRESS), i32(inner.numbers(RESPONSE_PORT) & 0xFFFF),
        protocol, i32(size), outer.text(IDENTITY), outer.text(VERSION), message,
        pa.array(reasons, pa.string()),
    ]


def _with_message(ddl: str) -> T.StructType:
    from namestrata.schemas import MESSAGE as message

    return T.DataType.fromDDL(f"struct<{ddl}dns {message}, error STRING>")


def decode_dnstap(frames: DataFrame, column: str = "frame", seq: str = "seq") -> DataFrame:
    """All frames with ``error``; invalid ones are kept so they can be counted."""
    return map_records(frames, column, _parse_dnstap, _with_message(_EVENT), [seq])


def dnstap_results(frames: DataFrame, column: str = "frame", seq: str = "seq") -> DataFrame:
    """DNS results of valid frames. Addresses are not masked on this path."""
    rows = decode_dnstap(frames, column, seq).filter("error IS NULL")
    return rows.withColumnRenamed(seq, "seq").select(*DNS_RESULT_COLUMNS)


# --- event records ---------------------------------------------------------------------------

# Field numbers of the event record, in table order.
EVENT_FIELDS = {
    "ts_ns": 1, "src_ip": 2, "dst_ip": 3, "src_port": 4, "dst_port": 5, "ip_version": 6,
    "protocol": 7, "packet_length": 8, "identity": 9, "version": 10, "qname": 11, "qtype": 12,
    "rcode": 13, "is_response": 14, "dns_wire": 15,
}

EVENT_SCHEMA = (
    "ts TIMESTAMP, ts_ns BIGINT, src_ip BINARY, dst_ip BINARY, src_port INT, dst_port INT, "
    "ip_version INT, protocol STRING, packet_length INT, identity STRING, version STRING, "
    "qname STRING, qtype INT, rcode INT, is_response BOOLEAN, dns_wire BINARY, valid BOOLEAN"
)


def _parse_event(column: pa.Array) -> list[pa.Array]:
    buf = Buffer(column)
    f = EVENT_FIELDS
    got = Fields(buf, buf.begin, buf.end, tuple(f.values()))
    ns = got.value[f["ts_ns"]].view(np.int64)

    def i32(name):
        return pa.array(got.numbers(f[name]).astype(np.int32))

    return [
        _stamp(ns), pa.array(ns), got.data(f["src_ip"]), got.data(f["dst_ip"]), i32("src_port"),
        i32("dst_port"), i32("ip_version"), got.text(f["protocol"]), i32("packet_length"),
        got.text(f["identity"]), got.text(f["version"]), got.text(f["qname"]), i32("qtype"),
        i32("rcode"), pa.array(got.numbers(f["is_response"]) != 0), got.data(f["dns_wire"]),
        pa.array(got.ok),
    ]


def read_events(records: DataFrame, column: str = "value", carried: tuple[str, ...] = ()) -> DataFrame:
    """Event records to columns; the message itself stays packed in ``dns_wire``."""
    schema = T.DataType.fromDDL(f"struct<{EVENT_SCHEMA}>")
    return map_records(records, column, _parse_event, schema, list(carried)).filter("valid").drop("valid")
