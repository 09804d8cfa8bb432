"""Packets of the sample traffic, rendered at once, against the packers of the library."""

from pyspark.sql import functions as F

from namestrata.functions import wire
from namestrata.plans import packets, traffic
from namestrata.plans.capture import packets_to_results
from namestrata.session import cut_lineage
from tests.conftest import SF

ODD = [
    (7, None, "view"), (10, None, "click"), (9, 3, None), (66, 4, None), (-1, 5, "view"), (-3, -7, "error"),
    (3000000000, 5, "a.b"), (3000000003, 5, ".."), (3000000006, 6, "a\\.b"), (3000000009, 6, "\\065x\\9"),
    (3000000012, 6, "end\\"), (3000000015, 6, "\\999"), (3000000018, 6, "é \\ ü"), (3000000021, 6, "x" * 70),
    (3000000024, 6, "y" * 300), (3000000030, 1234567, ""), (3000000033, 7, "a\nb"), (3000000036, 7, "\\\n"),
    (4100000000123, 9, "error"), *[(-1000 - k, k - 60, "minus") for k in range(120)],
]


def events_of(spark):
    odd = spark.createDataFrame(ODD, "event_id BIGINT, user_id BIGINT, event_type STRING")
    odd = odd.withColumns({"ts": F.timestamp_micros(F.lit(1_700_000_000_123_456)).cast("timestamp_ntz"), "value": F.lit(1.0)})
    return traffic.load_events(spark, SF).select("event_id", "user_id", "event_type", "ts", "value").union(odd)


def test_messages_are_those_of_the_packer(spark):
    events = events_of(spark).coalesce(1)
    wanted = {r.seq: r.wire and bytes(r.wire) for r in traffic.wired(traffic.results_of(events)).select("seq", "wire").collect()}
    rows = events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type")
    made = packets._columns(rows.toArrow().combine_chunks().to_batches()[0])
    assert dict(zip(made["e"], made["wire"])) == wanted


def test_frames_are_those_of_the_packer(spark):
    """The plain packet, the last fragment and the SYN, and no packet without an address."""
    events = events_of(spark)
    rows = traffic.wired(traffic.results_of(events))
    e = F.col("seq")
    body = wire.udp_hex(F.lit(4000), F.lit(53), F.col("wire"))
    part = F.substring(body, 33, 1 << 20)
    header6 = F.concat(F.lit("11000010"), wire.hex_uint(e, 4), part)
    last = F.when(
        F.col("ip_version") == 4, wire.ip_hex(F.col("src_ip"), F.col("dst_ip"), F.lit(17), part, e % 65536, F.lit(2))
    ).otherwise(wire.ip_hex(F.col("src_ip"), F.col("dst_ip"), F.lit(44), header6))
    number = F.pmod(F.lit(4294967200) + e % 150, F.lit(1 << 32))
    syn = wire.ip_hex(
        F.col("src_ip"), F.col("dst_ip"), F.lit(6), wire.tcp_hex(1024 + e % 60000, F.lit(53), number, F.lit(2), F.lit(""))
    )
    wanted = rows.select("seq", *[F.unhex(wire.ethernet_hex(F.col("src_ip"), x)).alias(n) for n, x in (("last", last), ("syn", syn))])
    fragments = traffic.fragment_packets_of(events).filter("pmod(seq, 4) = 2").select(F.expr("floor(seq / 4)").alias("seq"), "data")
    opened = traffic.tcp_packets_of(events).filter("pmod(seq, 8) = 0").select(F.expr("floor(seq / 8)").alias("seq"), "data")
    for column, found in (("last", fragments), ("syn", opened)):
        mine = wanted.select("seq", F.col(column).alias("data"))
        assert mine.exceptAll(found).count() == 0 and found.exceptAll(mine).count() == 0
    assert rows.count() == traffic.udp_packets_of(events).count()
    assert traffic.udp_packets_of(events).filter("data IS NULL").count() == 2


def test_rendering_needs_no_record(spark):
    """Records with their lists are built by expressions with lambdas, row by row."""
    for made in (traffic.udp_packets_of, traffic.fragment_packets_of, traffic.tcp_packets_of):
        plan = made(traffic.load_events(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan


def test_capture_plan_rebuilds_once_and_hands_over_what_is_read(spark):
    """Rebuilt datagrams serve the UDP and the TCP path from one table; columns nobody reads stay behind."""
    parts = [traffic.udp_packets(spark, SF), traffic.fragment_packets(spark, SF), traffic.tcp_packets(spark, SF)]
    packets_in = cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]), "capture")
    whole = packets_to_results(packets_in, mask_v4=24)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "ip_id" not in plan
    columns = ["seq", "ts", "src_ip", "src_port", "protocol", "identity"]
    few = packets_to_results(packets_in, mask_v4=24, columns=columns)
    assert sorted(few.columns) == sorted(columns)
    wanted = whole.select(*few.columns)
    assert few.count() > 4000 and few.exceptAll(wanted).count() == 0 and wanted.exceptAll(few).count() == 0
