"""Datagrams to DNS results: decode, build records, mask, merge."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namestrata.functions.arrow_steps import STEP, keep, pick, then
from namestrata.functions.ip import mask_ip_of
from namestrata.functions.wire import message_bytes
from namestrata.operators.counters import Counters, watched
from namestrata.schemas import DNS_RESULT_COLUMNS, MESSAGE
from namestrata.sources.dns_wire import decode_messages


def message_type() -> T.StructType:
    return T.DataType.fromDDL(MESSAGE)


def unpack(df: DataFrame, wire: str = "payload", keep_wire: bool = False) -> DataFrame:
    """Add ``dns`` (the decoded message) and ``error`` (why it could not be decoded).

    A malformed message never fails the task; it yields a NULL ``dns`` and its reason.
    """
    kept = df if keep_wire else df.drop(wire)
    fields = [f for f in kept.schema.fields if f.name not in ("dns", "error")]
    names = [f.name for f in fields]
    schema = T.StructType(
        [*fields, T.StructField("dns", message_type()), T.StructField("error", T.StringType())]
    )

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            message, error = decode_messages(batch.column(wire))
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, message, error], names=[*names, "dns", "error"])

    return then(pick(df, list(dict.fromkeys([*names, wire]))), job, schema)


def pack(df: DataFrame, out: str = "dns_wire", dns: str = "dns") -> DataFrame:
    """Add the wire form of the message."""
    return df.withColumn(out, message_bytes(F.col(dns)))


def _masked(v4_bits: int, v6_bits: int) -> dict:
    return {ip: mask_ip_of(F.col(ip), v4_bits, v6_bits) for ip in ("src_ip", "dst_ip")}


def _sized(payloads: DataFrame) -> DataFrame:
    """Add ``packet_length``, the size of the payload."""
    if not hasattr(payloads, STEP):
        return payloads.withColumn("packet_length", F.octet_length("payload"))
    names = [c for c in payloads.columns if c != "packet_length"]
    schema = T.StructType([*[payloads.schema[n] for n in names], T.StructField("packet_length", T.IntegerType())])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("payload")).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], size], names=schema.names)

    return then(payloads, job, schema)


def _decoded(
    payloads: DataFrame, v4_bits: int, v6_bits: int, counters: Counters | None, columns: list[str]
) -> DataFrame:
    rows = unpack(_sized(payloads))
    broken = F.col("error").isNotNull()
    rows = watched(counters, rows, unpackErrors=broken, messagesDecoded=~broken)
    rows = keep(rows, F.col("error").isNull(), lambda b: pc.is_null(b.column("error")))
    # Every message is decoded; what nobody reads of it does not leave Python.
    rows = pick(rows, [c for c in rows.columns if c in columns])
    return rows.withColumns({ip: mask for ip, mask in _masked(v4_bits, v6_bits).items() if ip in columns})


def udp_records(
    payloads: DataFrame, v4_bits: int = 32, v6_bits: int = 128, counters: Counters | None = None,
    columns: list[str] = DNS_RESULT_COLUMNS,
) -> DataFrame:
    """Decoded UDP payloads as results: ports kept, size of the payload, masked addresses."""
    rows = _decoded(payloads, v4_bits, v6_bits, counters, columns)
    return _as_results(rows, "udp", columns)


def tcp_records(
    messages: DataFrame, v4_bits: int = 32, v6_bits: int = 128, counters: Counters | None = None,
    columns: list[str] = DNS_RESULT_COLUMNS,
) -> DataFrame:
    """Decoded TCP messages as results: no ports, the time the stream began."""
    rows = _decoded(messages, v4_bits, v6_bits, counters, columns)
    nothing = F.lit(None).cast("int")
    return _as_results(rows.withColumns({"src_port": nothing, "dst_port": nothing}), "tcp", columns)


def _as_results(rows: DataFrame, protocol: str, columns: list[str]) -> DataFrame:
    text = F.lit(None).cast("string")
    rows = rows.withColumns({"protocol": F.lit(protocol), "identity": text, "version": text})
    return rows.select(*[c for c in DNS_RESULT_COLUMNS if c in columns])


def merge_results(*parts: DataFrame) -> DataFrame:
    """One result table from the UDP, reassembled and TCP paths."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged
