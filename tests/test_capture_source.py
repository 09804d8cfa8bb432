"""Captures as a data source: all packets of several files, formats and link types; pruning and filters."""

import pytest
from pyspark.sql import datasource as api
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from namestrata.plans import traffic
from namestrata.schemas import PACKETS
from namestrata.sources import capture_source, captures
from tests.conftest import SF

SPLIT = 60_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    for kind in ("pcap", "pcapng"):
        (folder / kind).mkdir()
        traffic.write_captures(traffic.capture_files(spark, SF, kind, 4_000), str(folder / kind))
    (folder / "notes.txt").write_text("no capture")
    return str(folder)


@pytest.fixture(scope="module")
def index(spark, folder, tmp_path_factory):
    capture_source.register(spark)
    return capture_source.write_index(spark, str(tmp_path_factory.mktemp("index") / "i"), folder, split_bytes=SPLIT)


@pytest.fixture(scope="module")
def whole(spark, folder):
    """All packets as whole-file reading gives them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return {(r.file, r.seq): r for r in captures.packets_from_contents(files).collect()}


def load(spark, index, schema=PACKETS):
    return spark.read.format("captures").schema(schema).option("index", index).option("splitBytes", SPLIT).load()


def reader(index, schema=PACKETS):
    return capture_source.CaptureReader(index, SPLIT, StructType.fromDDL(schema))


def test_all_packets(spark, index, whole):
    df = load(spark, index)
    got = df.collect()
    assert len(got) == len(whole)
    assert all(whole[r.file, r.seq] == r for r in got)
    assert {r.link_type for r in got} == {1, 101}
    # A file is read by several tasks.
    assert df.rdd.getNumPartitions() > len({r.file for r in got}) > 2


def test_columns(spark, index, whole):
    df = load(spark, index, "link_type INT, seq BIGINT")
    assert df.columns == ["link_type", "seq"]
    assert sorted(map(tuple, df.collect())) == sorted((r.link_type, r.seq) for r in whole.values())
    assert load(spark, index, "seq BIGINT").filter("seq >= 0").count() == len(whole)


@pytest.mark.parametrize("condition, holds", [
    ("seq = 17", lambda r: r.seq == 17),
    ("seq > 900 AND seq <= 1200", lambda r: 900 < r.seq <= 1200),
    ("seq IN (3, 1000, 99999)", lambda r: r.seq in (3, 1000, 99999)),
    ("link_type = 101 AND caplen < 90", lambda r: r.link_type == 101 and r.caplen < 90),
    ("wirelen >= 80 OR seq = 1", lambda r: r.wirelen >= 80 or r.seq == 1),
    ("seq < 0", lambda r: False),
    ("octet_length(data) > 85", lambda r: len(r.data) > 85),
])
def test_filters(spark, index, whole, condition, holds):
    got = load(spark, index).filter(condition).collect()
    assert sorted((r.file, r.seq) for r in got) == sorted(k for k, r in whole.items() if holds(r))


def test_time_and_file(spark, index, whole):
    file, middle = min(f for f, _ in whole), sorted(r.ts_ns for r in whole.values())[len(whole) // 2]
    got = load(spark, index).filter((F.col("file") == file) & (F.col("ts_ns") < middle)).collect()
    assert sorted(r.seq for r in got) == sorted(s for (f, s), r in whole.items() if f == file and r.ts_ns < middle)


def test_splits_left_out(spark, index, whole):
    everything = sum(len(p.rows) for p in reader(index).partitions())
    few = reader(index)
    rest = list(few.pushFilters([api.EqualTo(("seq",), 5), api.IsNotNull(("seq",)), api.IsNotNull(("data",))]))
    assert rest == [api.IsNotNull(("data",))]
    rows = [r for p in few.partitions() for r in p.rows]
    assert len(rows) == len({f for f, _ in whole}) < everything
    one = reader(index)
    assert not list(one.pushFilters([api.In(("file",), (min(f for f, _ in whole),))]))
    assert {r["path"] for p in one.partitions() for r in p.rows} == {min(f for f, _ in whole)}


def test_small_splits_share_a_task(index):
    wide = capture_source.CaptureReader(index, 1 << 30, StructType.fromDDL(PACKETS))
    assert len(wide.partitions()) == 1


def test_no_captures(spark, tmp_path):
    (tmp_path / "a.txt").write_text("no capture")
    assert capture_source.open_captures(spark, str(tmp_path)).count() == 0


def test_unknown_column(spark, index):
    with pytest.raises(Exception, match="captures have no column"):
        load(spark, index, "seq STRING").collect()
    with pytest.raises(Exception, match="option index"):
        spark.read.format("captures").load().collect()


def test_names_of_s3():
    assert captures.arrow_uri("s3a://bucket/day/a.pcap") == "s3://bucket/day/a.pcap"
    assert captures.arrow_uri("S3N://bucket/a") == "s3://bucket/a"
    assert captures.arrow_uri("hdfs://node:8020/a") == "hdfs://node:8020/a"
    assert captures.arrow_uri("/data/s3a/a") == "/data/s3a/a"


def test_small_splits_share_tasks(index, monkeypatch):
    """Tasks do not grow in number with the splits, and no split is lost."""
    every = [r for p in reader(index).partitions() for r in p.rows]
    monkeypatch.setattr(capture_source, "MANY_TASKS", 2)
    tasks = [p.rows for p in reader(index).partitions()]
    assert [r for t in tasks for r in t] == every and len(tasks) <= 4 < len(every)


def test_packets_are_not_taken_for_as_small_as_their_index(spark, folder):
    """A join with packets is none that gathers them all at the driver."""
    read = captures.read_captures(spark, folder, split_bytes=SPLIT).select("ts_ns", F.sha2("data", 256).alias("digest"))
    many = spark.range(1 << 40).select(F.col("id").alias("ts_ns"), F.col("id").cast("string").alias("digest"))
    plan = many.join(read, ["ts_ns", "digest"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [ts_ns" in plan and "BroadcastHashJoin [ts_ns" not in plan
