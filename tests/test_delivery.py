"""Counters of a plan, delivery to several outputs, replayed blocks and the end of a stream."""

import pytest
from pyspark.sql import functions as F

from namestrata.operators import sampling
from namestrata.operators.counters import Counters
from namestrata.operators.headers import ip_datagrams, on_port, transport
from namestrata.operators.reassembly import tcp_messages
from namestrata.plans import traffic
from namestrata.plans.capture import packets_to_results
from namestrata.session import cut_lineage
from namestrata.sinks import tables
from namestrata.sinks.delivery import Commits, active_outputs, deliver
from namestrata.sources.domain_lists import domain_list_from
from namestrata.streaming import jobs
from namestrata.streaming.reassembly import tcp_messages_stream
from tests.conftest import SF


def test_counters_add_up_over_jobs(spark):
    seen = Counters()
    rows = seen.watch(spark.range(10), small=F.col("id") < 3, odd=F.col("id") % 2 == 1)
    more = seen.watch(spark.range(5), odd=F.col("id") % 2 == 1)
    assert rows.count() == 10 and more.count() == 5
    seen.add(other=7)
    assert seen.totals() == {"odd": 7, "other": 7, "small": 3}
    assert seen.row(spark).first().asDict() == seen.totals()


def test_capture_without_fragments_or_flows_runs_no_reassembly(spark, monkeypatch):
    """Nothing is set aside, so nothing is rebuilt; what there is is counted."""
    from namestrata.plans import capture

    monkeypatch.setattr(capture, "reassemble_fragments", None)
    monkeypatch.setattr(capture, "tcp_messages", None)
    seen = Counters()
    packets = cut_lineage(traffic.udp_packets(spark, SF), "packets")
    results = packets_to_results(packets, ratio="1:3", counters=seen)
    count = results.count()
    totals = seen.totals()
    assert totals["messagesDecoded"] == count > 0
    kept = packets.filter(sampling.sample_condition(F.col("seq") + 1, 1, 3)).count()
    assert totals["packetsCaptured"] - totals["packetsOverRatio"] == kept


def some_results(spark):
    return cut_lineage(traffic.results(spark, SF), "results")


def test_a_block_that_comes_again_is_written_once(spark, tmp_path):
    results = some_results(spark)
    calls = []
    tables.register_sink("listed", lambda df, o: calls.append(df.count()))
    outputs = [
        ("parquet", 1, {"path": f"{tmp_path}/rows"}), ("log", 1, {"path": f"{tmp_path}/log"}),
        ("frames", 1, {"path": f"{tmp_path}/syslog", "name": "syslog"}),
        ("file", 1, {"path": f"{tmp_path}/lines", "fmt": "csv_no_header", "compression": "none"}), ("listed", 1, {}),
    ]
    commits = Commits(spark, f"{tmp_path}/delivered")

    def state():
        read = spark.read.option("recursiveFileLookup", "true")
        return [read.parquet(f"{tmp_path}/{n}").count() for n in ("rows", "log", "syslog")] + [read.text(f"{tmp_path}/lines").count(), len(calls)]

    deliver(results, outputs, block=0, commits=commits)
    first = state()
    deliver(results, outputs, block=0, commits=commits)
    assert state() == first and first[-1] == 1
    # Records that were lost with a failure: outputs with folders replace the block.
    deliver(results, outputs[:4], block=0, commits=Commits(spark, f"{tmp_path}/other"))
    assert state() == first
    deliver(results, outputs, block=1, commits=commits)
    assert state() == [2 * n for n in first]


def test_a_failing_output_is_counted_or_raised(spark, tmp_path):
    results = some_results(spark)

    def fails(df, options):
        raise OSError("gone")

    tables.register_sink("failing", fails)
    skip = domain_list_from(spark, ["example.com.,suffix"])
    outputs = [("failing", 2, {}), ("parquet", 2, {"path": f"{tmp_path}/rows", "label": "kept"}), ("stdout", 0, {})]
    with pytest.raises(OSError):
        deliver(results, outputs, skip)
    seen = Counters()
    deliver(results, outputs, skip, counters=seen)
    totals = seen.totals()
    rows = spark.read.parquet(f"{tmp_path}/rows").count()
    assert totals["keptSentToOutput"] == rows == totals["failingFailed"] and totals["keptSkipped"] > 0
    with pytest.raises(ValueError):
        active_outputs([("stdout", 0, {})])


def test_replayed_micro_batch_leaves_every_output_as_it_was(spark, tmp_path):
    """The stream's own record of a batch is taken away, so it runs again."""
    import shutil

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.limit(200).write.parquet(f"{tmp_path}/in")
    stream = lambda: traffic.results_of(jobs.read_folder(spark, f"{tmp_path}/in", events.schema))
    outputs = [("parquet", 1, {"path": f"{tmp_path}/rows"}), ("frames", 1, {"path": f"{tmp_path}/elastic", "name": "elastic"})]
    go = lambda: jobs.fan_out(stream(), outputs, f"{tmp_path}/checkpoint").awaitTermination()
    count = lambda: [spark.read.parquet(f"{tmp_path}/{n}").count() for n in ("rows", "elastic")]
    go()
    before = count()
    shutil.rmtree(f"{tmp_path}/checkpoint/commits")
    go()
    assert count() == before and before[0] > 0


def test_copies_of_two_captures_are_kept_apart_in_streams(spark, tmp_path):
    rows = [("a", 1, b"x"), ("a", 2, b"x"), ("b", 3, b"x"), ("b", 4, b"y")]
    packets = spark.createDataFrame(rows, "file string, seq bigint, data binary").withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    packets.write.parquet(f"{tmp_path}/in")
    stream = jobs.read_folder(spark, f"{tmp_path}/in", packets.schema)
    kept = jobs.run_to_end(jobs.drop_copies_stream(stream, 60, by=("file",)), "copies")
    batch = sampling.drop_copies(packets, 60, by=("file",))
    count = lambda df: sorted(tuple(r) for r in df.groupBy("file").count().collect())
    assert count(kept) == count(batch) == [("a", 1), ("b", 2)]


def test_end_of_a_stream_hands_out_windows_and_unfinished_flows(spark, tmp_path):
    """What no later row would ever close: the newest window, and flows without an idle pause."""
    events = spark.read.parquet(f"{SF}/events.parquet").limit(60)
    events.write.parquet(f"{tmp_path}/in")
    stream = jobs.read_folder(spark, f"{tmp_path}/in", events.schema)

    log = traffic.log_of(stream).withColumn("PacketTime", F.col("PacketTime").cast("timestamp"))
    closed = jobs.run_to_end(jobs.windowed_rollup(jobs.with_end(log, f"{tmp_path}/end1", "PacketTime"), "type", "1 day"), "w", end=f"{tmp_path}/end1")
    batch = traffic.log_of(events).filter("QR = 0")
    assert closed.agg(F.sum("c")).first()[0] == batch.count() and closed.filter("year(DnsDate) = 9999").count() == 0

    packets = ip_datagrams(traffic.tcp_packets_of(events))
    segments = cut_lineage(on_port(transport(packets)), "segments")
    want = tcp_messages(segments).count()
    columns = segments.select("file", "seq", "ts", "ts_ns", "ip_version", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_seq", "tcp_flags", "payload")
    columns.write.parquet(f"{tmp_path}/segments")
    rows = jobs.read_folder(spark, f"{tmp_path}/segments", columns.schema)
    key = {"ip_version": 0, "src_ip": b"", "dst_ip": b"", "src_port": 0, "dst_port": 0, "seq": 0, "ts_ns": 0, "tcp_seq": 0, "tcp_flags": 0, "payload": b""}
    ended = jobs.with_end(rows, f"{tmp_path}/end2", "ts", key)
    got = jobs.run_to_end(tcp_messages_stream(ended), "flows", end=f"{tmp_path}/end2")
    assert got.count() == want


def test_newest_folders_stay_over_all_blocks(spark, tmp_path):
    results = some_results(spark)
    outputs = [("file", 1, {"path": f"{tmp_path}/lines", "fmt": "csv_no_header", "rotate": "day", "keep": 3})]
    for block in range(2):
        part = results.filter(F.col("seq") % 2 == block)
        deliver(part, outputs, block=block)
    days = {p.name for p in tmp_path.glob("lines/block=*/dns_date=*/period=*")}
    every = results.select(F.date_format("ts", "yyyyMMdd")).distinct().collect()
    assert {d[7:15] for d in days} == set(sorted(r[0] for r in every)[-3:])
    assert len({p.parent.parent.name for p in tmp_path.glob("lines/block=*/dns_date=*/period=*")}) == 2
