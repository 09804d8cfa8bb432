"""Copies, limits, deep tags, pruned reports and the scratch folder."""

import pytest
from pyspark.sql import functions as F

from namestrata.functions import wire
from namestrata.operators import headers, reports, sampling
from namestrata.session import shared_dir


def test_copies_within_capture_and_window(spark):
    rows = [("a", i, i, b"x%d" % (i % 3)) for i in range(100)] + [("b", i, i, b"x0") for i in range(100)]
    rows += [(None, i, 5, b"n") for i in range(4)]
    df = spark.createDataFrame(rows, "file string, seq long, s long, data binary").withColumn("ts", F.timestamp_seconds("s"))
    seen, want = set(), []
    for file, seq, s, data in rows:
        if (file, s // 60, data) not in seen:
            seen.add((file, s // 60, data))
            want.append((str(file), seq))
    kept = sampling.drop_copies(df, 60, by=("file",))
    assert sorted((str(r.file), r.seq) for r in kept.collect()) == sorted(want) and len(want) < 20
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and kept.columns == df.columns


@pytest.mark.parametrize("limit", [3, 1500])
def test_one_limit_for_all_sizes(spark, limit):
    df = spark.range(4000).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("flush"))
    got = sampling.limit_per_flush(df, limit, "flush").groupBy("flush").agg(F.count("*").alias("n"), F.max("seq").alias("m"))
    assert {(r.flush, r.n, r.m) for r in got.collect()} == {(k, limit, 2 * limit - 2 + k) for k in (0, 1)}


@pytest.mark.parametrize("tags", [0, 1, 2, 65, 300])
def test_any_number_of_tags(spark, tags):
    ip = wire.ip_hex(F.unhex(F.lit("0A000001")), F.unhex(F.lit("0A000002")), F.lit(17), wire.udp_hex(F.lit(53), F.lit(4000), F.unhex(F.lit("AABB"))))
    frame = F.unhex(wire.ethernet_hex(F.unhex(F.lit("0A000001")), ip, tuple(range(1, tags + 1))))
    packet = spark.range(1).select(
        F.lit("f").alias("file"), F.col("id").alias("seq"), F.current_timestamp().alias("ts"), F.lit(0).cast("long").alias("ts_ns"),
        F.lit(1).alias("link_type"), frame.alias("data"),
    )
    (row,) = headers.transport(headers.ip_datagrams(packet)).collect()
    assert (row.src_port, row.dst_port, bytes(row.payload)) == (53, 4000, b"\xaa\xbb")


def test_reports_prune_days(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.range(400).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id * 3)").alias("PacketTime"),
        F.concat(F.lit("n"), F.col("id") % 150).alias("Question"),
    )
    log = log.withColumn("dns_date", F.to_date("PacketTime"))
    log.write.partitionBy("dns_date").parquet(path)
    stored = spark.read.parquet(path)
    fresh = reports.new_domains(stored, "2024-02-15 00:00:00", 2, 10, day_column="dns_date")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: []") == 0 and plan.count("FileScan") == 1
    days = [(r.PacketTime.date().isoformat(), r.Question) for r in log.collect()]
    recent = {q for d, q in days if d > "2024-02-13"}
    before = {q for d, q in days if "2024-02-05" < d < "2024-02-13"}
    assert {r.Question for r in fresh.collect()} == recent - before and recent - before

    counts = stored.groupBy(F.col("dns_date").alias("DnsDate"), F.col("PacketTime").alias("t"), "Question").count()
    last = reports.distinct_domains(counts, "2024-02-15 00:00:00", 24)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Session(), "x")
    Session.conf = Conf({"spark.master": "local[2]"})
    assert shared_dir(Session(), "x").startswith(Session.conf["spark.checkpoint.dir"])


def test_newest_folders_stay(spark, tmp_path):
    from namestrata.operators.retention import drop_oldest_folders

    path = str(tmp_path / "files")
    rows = [(f"2024-01-{d:02}", f"202401{d:02}{h:02}", "x") for d in (1, 5, 9) for h in (3, 4)]
    spark.createDataFrame(rows, "day string, period string, value string").write.partitionBy("day", "period").text(path)
    gone = drop_oldest_folders(spark, path, 4)
    assert len(gone) == 2 and all("day=2024-01-01" in g for g in gone)
    assert spark.read.text(path).count() == 4
