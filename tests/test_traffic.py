"""Sample traffic: how its work is dealt out."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from namestrata.plans import traffic
from tests.conftest import SF


def one_group(folder, copies):
    """The events several times over as one row group, so a single task reads them all."""
    events = pq.read_table(f"{SF}/events.parquet")
    parts = []
    for k in range(copies):
        ids = pa.array([i + k * events.num_rows for i in events["event_id"].to_pylist()], events["event_id"].type)
        parts.append(events.set_column(events.schema.get_field_index("event_id"), "event_id", ids))
    table = pa.concat_tables(parts).combine_chunks()
    pq.write_table(table, f"{folder}/events.parquet", row_group_size=table.num_rows)
    return table.num_rows


def task_rows(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_tasks_are_even_and_bounded(spark, tmp_path, monkeypatch):
    """A file that reads as many partitions, all but one empty, and a table of many tasks' work."""
    rows = one_group(tmp_path, 20)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert traffic.load_events(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
        sizes = task_rows(traffic.spread_events(spark, str(tmp_path)))
        assert sum(sizes) == rows and max(sizes) <= 2 * rows / 8
        monkeypatch.setattr(traffic, "TASK_EVENTS", rows // 40)
        sizes = task_rows(traffic.spread_events(spark, str(tmp_path)))
        assert sum(sizes) == rows and max(sizes) <= 2 * rows / 40
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
