"""DNS traffic derived from the ``events`` table, for queries, tests and the bench.

Every event becomes one log row, one decoded record, one packet, and so on, so the work grows
with the table.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namestrata.functions import wire
from namestrata.functions.binary import hex_uint
from namestrata.functions.formats import to_event_bytes
from namestrata.functions.once import compute_once, pick_once
from namestrata.plans import packets
from namestrata.schemas import MESSAGE

#: Plain SQL that Spark and other engines read alike.
DNS_LOG_SQL = """
SELECT event_id AS seq, ts AS PacketTime,
 concat('srv', CAST(user_id % 4 AS VARCHAR(20))) AS Server,
 CASE WHEN event_id % 5 = 0 THEN 6 ELSE 4 END AS IPVersion,
 CASE WHEN event_id % 5 = 0 THEN concat('2001:db8::', CAST(user_id % 10 AS VARCHAR(20)))
      ELSE concat('10.0.', CAST(user_id % 7 AS VARCHAR(20)), '.', CAST(user_id % 250 AS VARCHAR(20))) END AS SrcIP,
 concat('192.0.2.', CAST(event_id % 3 + 1 AS VARCHAR(20))) AS DstIP,
 CASE WHEN event_id % 10 = 0 THEN 'tcp' ELSE 'udp' END AS Protocol,
 CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS QR,
 CASE WHEN event_id % 50 = 7 THEN 5 ELSE 0 END AS OpCode,
 CASE WHEN event_id % 97 = 0 THEN 3 ELSE 1 END AS Class,
 CASE event_id % 7 WHEN 0 THEN 28 WHEN 1 THEN 16 WHEN 2 THEN 15 WHEN 3 THEN 4321 ELSE 1 END AS Type,
 CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS Edns0Present,
 CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS DoBit,
 CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS ResponseCode,
 concat(event_type, CAST((event_id * 7919) % 2003 AS VARCHAR(20)), '.',
        CASE WHEN user_id % 2 = 0 THEN 'Example.com.' ELSE 'sample.org.' END) AS Question,
 CAST(floor(value) AS INT) % 1400 + 40 AS Size
FROM events
"""

SERVER_IP = "C0000202"  # 192.0.2.2


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


#: Events that one task derives, some seconds of work.
TASK_EVENTS = 50_000


def event_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks derive something from the events: all cores, and more with more rows.

    The rows are counted, from the footers. Partitions as read say nothing about the work: those of a
    file with few row groups are mostly empty.
    """
    return max(spark.sparkContext.defaultParallelism, -(-load_events(spark, sf_dir).count() // TASK_EVENTS))


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events dealt out evenly, for the derivations that cost far more than a shuffle of them."""
    return load_events(spark, sf_dir).repartition(event_tasks(spark, sf_dir))


def log_of(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(DNS_LOG_SQL.replace("FROM events", "FROM {events}"), events=events)


def dns_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat log (without its index time and full query, which carry no data here)."""
    return log_of(load_events(spark, sf_dir))


def results_of(events: DataFrame) -> DataFrame:
    """Decoded records: one, two or no questions, answers of several types, EDNS, two families."""
    log = log_of(events.select("event_id", "ts", "user_id", "event_type", "value"))
    log = log.withColumn("uid", F.regexp_extract("Server", "[0-9]+", 0).cast("int"))
    e, is6 = F.col("seq"), F.col("IPVersion") == 6
    v6_net = F.lit("20010DB8" + "0" * 8)
    host = F.element_at(F.split("SrcIP", r"[.:]"), -1).cast("int")
    src = F.when(is6, F.unhex(F.concat(v6_net, hex_uint(host, 8)))).otherwise(
        F.unhex(F.concat(F.lit("0A00"), hex_uint(F.split("SrcIP", r"\.")[2].cast("int"), 1), hex_uint(host, 1)))
    )
    dst = F.when(is6, F.unhex(F.concat(v6_net, hex_uint(e % 3 + 0x35, 8)))).otherwise(
        F.unhex(F.concat(F.lit("C00002"), hex_uint(e % 3 + 1, 1)))
    )
    question = F.struct(
        F.col("Question").alias("name"), F.col("Type").alias("qtype"), F.col("Class").alias("qclass")
    )
    second = F.struct(
        F.concat(F.lit("alt."), "Question").alias("name"), F.lit(1).alias("qtype"), F.lit(1).alias("qclass")
    )
    response = F.col("QR") == 1

    def record(kind, data, size):
        return F.struct(
            F.col("Question").alias("name"), F.lit(kind).alias("rrtype"), F.lit(1).alias("class"),
            (e % 86400).cast("bigint").alias("ttl"), size.cast("int").alias("rdlength"),
            data.alias("rdata"),
        )

    target = F.concat(F.lit("host"), (e % 17).cast("string"), F.lit(".example.net."))
    wire_name = F.length(target) + 1
    text = F.concat(F.lit('"v=spf1 id='), e.cast("string"), F.lit('" "second"'))
    text_size = F.length(e.cast("string")) + 18
    ip_a = F.concat(F.lit("203.0.113."), (e % 250).cast("string"))
    answers = F.array(
        record(5, target, wire_name),
        F.when(e % 4 == 0, record(28, F.concat(F.lit("2001:db8::"), F.lower(F.hex(e % 4096 + 1))), F.lit(16)))
        .when(e % 4 == 1, record(15, F.concat((e % 90).cast("string"), F.lit(" "), target), wire_name + 2))
        .when(e % 4 == 2, record(16, text, text_size))
        .otherwise(record(1, ip_a, F.lit(4))),
    )
    soa = F.concat(target, F.lit(" admin.example.net. "), e.cast("string"), F.lit(" 7200 3600 1209600 300"))
    authority = F.array(record(6, soa, wire_name + 19 + 20), record(2, target, wire_name))
    opt = F.struct(
        F.lit(".").alias("name"), F.lit(41).alias("rrtype"), F.lit(1232).alias("class"),
        F.when(F.col("DoBit") == 1, 32768).otherwise(0).cast("bigint").alias("ttl"),
        F.lit(0).alias("rdlength"), F.lit("").alias("rdata"),
    )
    none = F.array()
    dns = F.struct(
        F.pmod(e * 31, F.lit(65536)).cast("int").alias("id"), response.alias("response"),
        F.col("OpCode").alias("opcode"), (response & (e % 2 == 1)).alias("authoritative"),
        (e % 61 == 0).alias("truncated"), (e % 8 != 0).alias("recursion_desired"),
        response.alias("recursion_available"), F.lit(False).alias("zero"),
        (e % 9 == 0).alias("authenticated_data"), (e % 12 == 0).alias("checking_disabled"),
        F.col("ResponseCode").alias("rcode"),
        F.when(e % 13 == 5, none).when(e % 11 == 0, F.array(question, second))
        .otherwise(F.array(question)).alias("question"),
        F.when(response, answers).otherwise(none).alias("answer"),
        F.when(response & (e % 6 == 0), authority).otherwise(none).alias("ns"),
        F.when(F.col("Edns0Present") == 1, F.array(opt)).otherwise(none).alias("extra"),
    ).cast(MESSAGE)
    ts = F.col("PacketTime").cast("timestamp")
    return pick_once(
        log, F.col("seq"), ts.alias("ts"), (F.unix_micros(ts) * 1000 + e % 1000).alias("ts_ns"),
        F.col("IPVersion").alias("ip_version"), src.alias("src_ip"),
        F.when(F.col("Protocol") == "udp", F.when(response, 53).otherwise(1024 + e % 60000))
        .cast("int").alias("src_port"),
        dst.alias("dst_ip"),
        F.when(F.col("Protocol") == "udp", F.when(response, 1024 + e % 60000).otherwise(53))
        .cast("int").alias("dst_port"),
        F.col("Protocol").alias("protocol"), F.col("Size").alias("packet_length"),
        F.col("Server").alias("identity"), F.lit("v1").alias("version"), dns.alias("dns"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_of(spread_events(spark, sf_dir))


def wired(rows: DataFrame) -> DataFrame:
    """Add ``wire``, the packed message."""
    return compute_once(rows, {"wire": wire.message_bytes(F.col("dns"))})


def udp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udp_packets_of(spread_events(spark, sf_dir))


def udp_packets_of(events: DataFrame) -> DataFrame:
    """Every event as a UDP packet: plain, one VLAN tag, two tags, VXLAN or raw IP.

    Every 23rd packet is damaged and every 19th uses another port.
    """
    return packets.packets_of(events, packets.udp)


def fragment_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_packets_of(spread_events(spark, sf_dir))


def fragment_packets_of(events: DataFrame) -> DataFrame:
    """Every event as three IP fragments of at least 24 bytes each, out of order.

    Every 29th datagram lacks its middle piece and every 31st repeats its first one.
    """
    return packets.packets_of(events, packets.fragments)


def tcp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tcp_packets_of(spread_events(spark, sf_dir))


def tcp_packets_of(events: DataFrame) -> DataFrame:
    """Events as TCP traffic: one stream per event, three messages cut into odd segments.

    A SYN opens each stream; segments arrive out of order and one is sent twice.
    """
    return packets.packets_of(events, packets.tcp)


def dnstap_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dnstap_frames_of(spread_events(spark, sf_dir))


def dnstap_frames_of(events: DataFrame) -> DataFrame:
    """Every event as a dnstap frame: query only, response only or both; every 23rd is cut."""
    rows = wired(results_of(events))
    e = F.col("seq")
    has_query, has_response = e % 3 != 1, e % 3 != 0
    sec, nsec = F.unix_seconds("ts"), F.pmod("ts_ns", F.lit(1_000_000_000))

    def only(condition, field):
        return F.when(condition, field).otherwise("")

    message = F.concat(
        wire.proto_int(1, F.lit(5), 1),
        wire.proto_int(2, F.when(F.col("ip_version") == 4, 1).otherwise(2), 1),
        wire.proto_int(3, F.when(F.col("protocol") == "udp", 1).otherwise(2), 1),
        wire.proto_bytes(4, F.hex("src_ip")), wire.proto_bytes(5, F.hex("dst_ip")),
        wire.proto_int(6, F.col("src_port"), 3), wire.proto_int(7, F.col("dst_port"), 3),
        only(has_query, wire.proto_int(8, sec, 5)), only(has_query, wire.proto_fixed32(9, nsec)),
        only(has_query, wire.proto_bytes(10, F.hex("wire"))),
        only(has_response, wire.proto_int(12, sec + 1, 5)),
        only(has_response, wire.proto_fixed32(13, nsec)),
        only(has_response, wire.proto_bytes(14, F.hex("wire"))),
    )
    frame = F.concat(
        wire.proto_bytes(1, F.hex(F.col("identity").cast("binary"))),
        wire.proto_bytes(2, F.hex(F.col("version").cast("binary"))),
        wire.proto_bytes(14, message), wire.proto_int(15, F.lit(1), 1),
    )
    rows = compute_once(rows, {"hex": frame})
    cut = F.substring(F.col("hex"), F.lit(1), F.length("hex") - 16)
    return rows.select("seq", F.unhex(F.when(e % 23 == 0, cut).otherwise(F.col("hex"))).alias("frame"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compute_once(results(spark, sf_dir), {"value": to_event_bytes()})
    return rows.select("seq", "value")


def capture_files(spark: SparkSession, sf_dir: str, kind: str = "pcap", records: int = 500) -> DataFrame:
    """Whole capture files of ``records`` packets each, in the shape of ``binaryFile`` rows.

    A classic file has one link type; a pcapng file has two interfaces, the second one declared
    where its first packet comes.
    """
    rows = udp_packets(spark, sf_dir).withColumn("number", F.expr(f"seq div {records}"))
    size = F.octet_length("data")
    if kind == "pcap":
        head = F.concat(F.lit("A1B23C4D00020004000000000000000000040000"), hex_uint(F.col("link_type"), 4))
        record = F.concat(
            hex_uint(F.expr("ts_ns div 1000000000"), 4), hex_uint(F.pmod("ts_ns", F.lit(1_000_000_000)), 4),
            hex_uint(size, 4), hex_uint(size, 4), F.hex("data"),
        )
        keys = ["number", "link_type"]
    else:
        section = "0A0D0D0A0000001C1A2B3C4D00010000FFFFFFFFFFFFFFFF0000001C"
        interface = "000000010000001C{}000000040000" + "0009000109000000" + "0000001C"
        head = F.lit(section + interface.format("0001"))
        pad = F.pmod(-size, F.lit(4))
        total = hex_uint(32 + size + pad, 4)
        raw = F.col("link_type") == 101
        first = raw & (F.col("seq") - F.col("number") * records == 4)
        record = F.concat(
            F.when(first, interface.format("0065")).otherwise(""),
            F.lit("00000006"), total, F.when(raw, "00000001").otherwise("00000000"), hex_uint(F.shiftright("ts_ns", 32), 4),
            hex_uint(F.col("ts_ns"), 4), hex_uint(size, 4), hex_uint(size, 4), F.hex("data"),
            F.repeat(F.lit("00"), pad), total,
        )
        keys = ["number"]
    # At most ``records`` packets per file, so no group grows with the table.
    packed = rows.withColumn("record", record).withColumn("head", head).groupBy(*keys).agg(
        F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("seq", "record"))).alias("all")
    )
    content = F.concat("head", F.array_join(F.transform("all", lambda r: r["record"]), ""))
    return packed.select(
        F.concat_ws("-", F.lit("file"), *[F.col(k).cast("string") for k in keys]).alias("path"),
        F.unhex(content).alias("content"),
    )


def write_captures(files: DataFrame, folder: str) -> int:
    """Capture files as real files below a folder that all executors see; returns how many."""

    def job(batches):
        for batch in batches:
            system, base = arrow_fs.FileSystem.from_uri(folder) if ":/" in folder else (arrow_fs.LocalFileSystem(), folder)
            system.create_dir(base)
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    return files.select("path", "content").mapInArrow(job, "path STRING").count()
