"""The same work as streams: copies, rollups, fan-out, list reload, progress."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from namestrata.operators.counters import Counters
from namestrata.operators.rollups import ROLLUPS, finalize, merge_rollup, partial_rollup
from namestrata.operators.sampling import packet_hash
from namestrata.session import shared_dir
from namestrata.sinks.delivery import Commits, Output, active_outputs, deliver


def trigger_options(delay_seconds: float = 0, available_now: bool = False) -> dict:
    """Flush by delay when one is given; otherwise as soon as data is there.

    A flush by size is a limit of the source (``maxFilesPerTrigger`` or
    ``maxOffsetsPerTrigger``), see :func:`read_folder`.
    """
    if available_now:
        return {"availableNow": True}
    return {"processingTime": f"{delay_seconds} seconds"} if delay_seconds > 0 else {}


def read_folder(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None,
    fmt: str = "parquet", names: str | None = None,
) -> DataFrame:
    """A folder as a stream; ``names`` is a file name pattern, ``files_per_batch`` the flush size."""
    reader = spark.readStream.schema(schema).format(fmt)
    if names:
        reader = reader.option("pathGlobFilter", names)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def drop_copies_stream(
    packets: DataFrame, seconds: int = 60, data: str = "data", time: str = "ts", late: int = 60,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """First copy per tumbling window of event time, of each capture by its columns ``by``.

    The watermark runs on the window's start, so the copies of a window are forgotten once it
    has passed by ``late`` seconds.
    """
    start = F.window(time, f"{seconds} seconds")["start"]
    keyed = packets.withColumns({"__hash": packet_hash(F.col(data)), "__window": start})
    marked = keyed.withWatermark("__window", f"{seconds + late} seconds")
    return marked.dropDuplicates([*by, "__window", "__hash"]).drop("__window", "__hash")


def windowed_rollup(log: DataFrame, name: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """A rollup over event-time windows, emitted once a window is final.

    A row at END only moves the watermark, see :func:`with_end`.
    """
    spec = ROLLUPS[name]
    rows = log.withWatermark("PacketTime", late)
    if spec.where:
        rows = rows.filter(F.expr(spec.where) | (F.col("PacketTime") >= end_time()))
    keys = [F.window("PacketTime", window).alias("__w"), "Server", *spec.keys]
    measures = []
    if spec.counts:
        measures.append(F.count(F.lit(1)).alias("c"))
    measures += [F.sum(src).alias(dst) for dst, src in spec.sums.items()]
    measures += [F.avg(src).alias(dst) for dst, src in spec.averages.items()]
    measures += [F.approx_count_distinct(src).alias(dst) for dst, src in spec.distinct.items()]
    rolled = rows.groupBy(*keys).agg(*measures)
    start = F.col("__w.start")
    return rolled.select(
        F.to_date(start).alias("DnsDate"), start.alias(spec.time_name),
        *[c for c in rolled.columns if c != "__w"],
    )


# --- rollup tables kept up to date -----------------------------------------------------------


def append_partials(batch: DataFrame, batch_id: int, path: str, names: list[str], grain: str | None = None) -> None:
    """Write what one block of log rows adds to each rollup.

    Every block owns its folder and overwrites it, so a block that is replayed after a
    failure counts once.
    """
    block = batch.persist()
    try:
        for name in names:
            part = partial_rollup(block, name, grain)
            part.write.mode("overwrite").parquet(f"{path}/{name}/block={batch_id}")
    finally:
        block.unpersist()


def maintain_rollups(
    log: DataFrame, path: str, checkpoint: str, names: list[str] | None = None,
    grain: str | None = None, **trigger,
) -> StreamingQuery:
    """Keep rollup tables under ``path`` up to date with a log stream."""
    chosen = names or list(ROLLUPS)

    def block(batch: DataFrame, batch_id: int) -> None:
        append_partials(batch, batch_id, path, chosen, grain)

    writer = log.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_rollup(spark: SparkSession, path: str, name: str, grain: str | None = None) -> DataFrame:
    """A maintained rollup: partial rows of all blocks merged on read."""
    parts = spark.read.parquet(f"{path}/{name}").drop("block")
    return finalize(merge_rollup(parts, name, grain), name)


def compact_rollup(spark: SparkSession, path: str, name: str, target: str) -> None:
    """Merge the blocks of a rollup into one table elsewhere, still mergeable."""
    parts = spark.read.parquet(f"{path}/{name}").drop("block")
    merge_rollup(parts, name).write.mode("overwrite").partitionBy("DnsDate").parquet(target)


# --- fan-out ---------------------------------------------------------------------------------


class ReloadedList:
    """A domain list that is loaded anew when older than ``seconds``.

    When loading fails, the last good list stays in use.
    """

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 60, clock=time.monotonic):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.current: DataFrame | None = None
        self.loaded_at: float | None = None

    def get(self) -> DataFrame | None:
        now = self.clock()
        if self.loaded_at is None or now - self.loaded_at >= self.seconds:
            self.loaded_at = now
            try:
                fresh = self.load().persist()
                fresh.count()
            except Exception:  # noqa: BLE001 - any failure keeps the list in use
                return self.current
            if self.current is not None:
                self.current.unpersist()
            self.current = fresh
        return self.current


def fan_out(
    results: DataFrame, outputs: list[Output], checkpoint: str,
    skip: ReloadedList | None = None, allow: ReloadedList | None = None, counters: Counters | None = None,
    **trigger,
) -> StreamingQuery:
    """Send every result to all outputs, see :func:`deliver`.

    A micro-batch is stored once and written to each output in turn, so outputs slow the
    stream down instead of losing records. A micro-batch that is replayed after a failure is
    written once: the records of who has it lie below ``checkpoint``.
    """
    active_outputs(outputs)
    commits = Commits(results.sparkSession, f"{checkpoint}-delivered")

    def block(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            lists = (skip.get() if skip else None, allow.get() if allow else None)
            deliver(rows, outputs, *lists, counters, batch_id, commits)
        finally:
            rows.unpersist()

    writer = results.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


# --- progress --------------------------------------------------------------------------------


class ProgressCounters(StreamingQueryListener):
    """Adds up observed counters of all micro-batches and hands each total to ``flush``."""

    def __init__(self, flush: Callable[[dict], None] | None = None):
        self.totals: dict[str, float] = {}
        self.flush = flush

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        for metric, row in event.progress.observedMetrics.items():
            for field, value in row.asDict().items():
                key = f"{metric}.{field}"
                self.totals[key] = self.totals.get(key, 0) + (value or 0)
        if self.flush:
            self.flush(dict(self.totals))

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


class StoredCounters(ProgressCounters):
    """Counters that outlive the program: each micro-batch's are a file below a shared folder, named by
    query and batch, so a batch that is replayed counts once and a restart goes on where it was."""

    def __init__(self, spark: SparkSession, folder: str, flush: Callable[[dict], None] | None = None):
        super().__init__(flush)
        self.spark, self.folder = spark, folder
        _ready(spark, folder)

    def onQueryProgress(self, event):  # noqa: N802
        self.record(event.progress)
        super().onQueryProgress(event)

    def record(self, progress) -> None:
        """Take one progress report, also one from ``recentProgress``."""
        rows = [
            {"name": f"{metric}.{field}", "value": value or 0}
            for metric, row in progress.observedMetrics.items() for field, value in row.asDict().items()
        ]
        if not rows:
            return
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{progress.id}-{progress.batchId}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray("\n".join(map(json.dumps, rows)).encode()))
        out.close()

    def stored(self) -> DataFrame:
        """(name, value): totals over all micro-batches of all runs."""
        rows = self.spark.read.schema("name STRING, value BIGINT").json(self.folder)
        return rows.groupBy("name").agg(F.sum("value").alias("value"))


#: A time after all rows.
END = "9999-01-01 00:00:00"


def end_time() -> Column:
    return F.lit(END).cast("timestamp")


def with_end(rows: DataFrame, folder: str, time: str, key: dict | None = None) -> DataFrame:
    """``rows`` and, once :func:`write_end` has put it below ``folder``, one row at END.

    The row has nothing but its time and the values of ``key``. It moves the watermark past all
    others, so that every window and timer left in the state is handed out.
    """
    spark = rows.sparkSession
    _ready(spark, folder)
    end = spark.readStream.schema(T.StructType([T.StructField("at", T.TimestampType())])).parquet(folder)
    filled = {n: F.lit(v) for n, v in (key or {}).items()}
    columns = [
        F.col("at").alias(f.name) if f.name == time
        else filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields
    ]
    # A batch in which one side has nothing is planned without it, so both must agree that any
    # column may be NULL, or the state of one batch would not fit the next; a map says so.
    bare = {f.name: F.element_at(F.create_map(F.lit(0), F.col(f.name)), F.lit(0)) for f in rows.schema.fields if not f.nullable}
    return rows.withColumns(bare).unionByName(end.select(*columns))


def write_end(spark: SparkSession, folder: str) -> None:
    spark.range(1).select(end_time().alias("at")).coalesce(1).write.mode("append").parquet(folder)


def _ready(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def run_to_end(stream: DataFrame, purpose: str, mode: str = "append", end: str | None = None) -> DataFrame:
    """Process everything a stream has to offer and read the outcome back as a table.

    With ``end``, the folder given to :func:`with_end`, the stream then goes on from its checkpoint
    over the end row, which flushes what is left in its state.
    """
    spark = stream.sparkSession
    folder = shared_dir(spark, purpose)

    def go() -> None:
        query = (
            stream.writeStream.format("parquet").outputMode(mode)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
            .start(f"{folder}/rows")
        )
        query.awaitTermination()

    go()
    if end:
        write_end(spark, end)
        go()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
