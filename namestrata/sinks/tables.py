"""Table and file sinks, and the sink registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namestrata.functions.formats import format_column, format_header
from namestrata.functions.timing import truncate
from namestrata.operators.retention import drop_oldest_folders
from namestrata.operators.rows import dns_log_rows, explode_questions, parquet_rows, postgres_rows, with_storage_key
from namestrata.sinks.frames import kafka_records, write_frames

# Parquet columns written with a dictionary.
DICTIONARY_COLUMNS = [
    "ip_version", "protocol", "qr", "opcode", "qclass", "qtype", "edns", "do_bit", "query_name",
]
PLAIN_COLUMNS = ["timestamp", "src_ip", "dst_ip", "rcode", "packet_length", "identity", "version"]


def write_parquet(results: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet rows with dictionaries on the coded columns and a bloom filter on the name."""
    writer = parquet_rows(results).write.mode(mode).option("compression", "snappy")
    for column in PLAIN_COLUMNS:
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    for column in DICTIONARY_COLUMNS:
        writer = writer.option(f"parquet.enable.dictionary#{column}", "true")
    writer = writer.option("parquet.bloom.filter.enabled#query_name", "true")
    writer.option("parquet.bloom.filter.fpp#query_name", "0.01").parquet(path)


def write_log(log: DataFrame, path: str, mode: str = "append", rows_per_file: int = 5_000_000) -> None:
    """The day-partitioned log, each file sorted by hour, server, reversed name and time.

    Rows are dealt out by day, hour and server in one exchange, whose sizes adaptive execution
    evens out: it splits what is large, so neither a busy hour nor a name that fills it is the work
    of one task, and puts small parts together. The input is evaluated once.
    """
    keyed = with_storage_key(log).withColumn("dns_date", F.to_date("PacketTime"))
    spread = keyed.hint("rebalance", F.col("dns_date"), F.col("hour"), F.col("Server"))
    ordered = spread.sortWithinPartitions("dns_date", "hour", "Server", "rq", "PacketTime")
    writer = ordered.drop("hour").write.mode(mode).partitionBy("dns_date")
    writer.option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log back, with ``dns_date`` for pruning and ``rq`` for suffix searches."""
    return spark.read.parquet(path)


def write_files(
    results: DataFrame, path: str, fmt: str = "json", rotate: str = "hour", keep: int | None = None,
    mode: str = "append", compression: str = "gzip", **options,
) -> None:
    """Text files per question, one folder per hour or day; the newest ``keep`` folders stay.

    A CSV header, when the format has one, is written as the first line of every file.
    """
    if rotate not in ("hour", "day"):
        raise ValueError(f"cannot rotate by {rotate!r}")
    rows = explode_questions(results)
    lines = rows.select(
        F.to_date("ts").alias("dns_date"),
        F.date_format(truncate(rows, "ts", rotate), "yyyyMMddHH").alias("period"),
        format_column(fmt, **options).alias("value"),
    ).filter("value IS NOT NULL")
    # Adaptive execution splits a large period over tasks and puts small ones together.
    lines = lines.hint("rebalance", F.col("dns_date"), F.col("period"))
    header = format_header(fmt)
    writer = lines.write.mode(mode).partitionBy("dns_date", "period").option("compression", compression)
    if header:
        # The csv writer puts its column name on top; nothing in a line is quoted.
        plain = lines.withColumnRenamed("value", header).write.mode(mode)
        plain = plain.partitionBy("dns_date", "period").option("compression", compression)
        plain.option("header", "true").option("quote", "\u0000").option("sep", "\u0001").csv(path)
    else:
        writer.text(path)
    if keep is not None:
        drop_oldest_folders(results.sparkSession, path, keep)


def write_postgres(results: DataFrame, url: str, table: str, mode: str = "append", **properties) -> None:
    """Append to a relational table over JDBC; address text is cast to ``inet`` by the server."""
    settings = {"stringtype": "unspecified", "reWriteBatchedInserts": "true", **properties}
    postgres_rows(results).write.jdbc(url, table, mode=mode, properties=settings)


KAFKA_COMPRESSION = ("none", "snappy", "gzip", "lz4", "zstd")


def kafka_options(servers: str, topic: str, compression: str = "snappy", **extra: str) -> dict[str, str]:
    """Writer options for the Kafka sink."""
    if compression not in KAFKA_COMPRESSION:
        raise ValueError(f"unknown Kafka compression {compression!r}")
    options = {
        "kafka.bootstrap.servers": servers, "topic": topic, "kafka.compression.type": compression,
    }
    return {**options, **{f"kafka.{k}": v for k, v in extra.items()}}


def write_kafka(results: DataFrame, servers: str, topic: str, fmt: str = "json", **extra: str) -> None:
    options = kafka_options(servers, topic, **extra)
    kafka_records(results, fmt).write.format("kafka").options(**options).save()


def show_lines(results: DataFrame, fmt: str = "json", n: int = 20, **options) -> DataFrame:
    """Rendered lines for the console: prints the first ``n`` and returns all of them."""
    lines = explode_questions(results).select(format_column(fmt, **options).alias("value"))
    lines = lines.filter("value IS NOT NULL")
    lines.show(n, truncate=False)
    return lines


# --- registry --------------------------------------------------------------------------------

Sink = Callable[[DataFrame, dict], None]

SINKS: dict[str, Sink] = {
    "parquet": lambda df, o: write_parquet(df, o["path"], o.get("mode", "append")),
    "log": lambda df, o: write_log(dns_log_rows(df, o.get("server", "default")), o["path"], o.get("mode", "append")),
    "frames": lambda df, o: write_frames(df, o["name"], o["path"], o.get("mode", "append")),
    "file": lambda df, o: write_files(df, **o),
    "postgres": lambda df, o: write_postgres(df, **o),
    "kafka": lambda df, o: write_kafka(df, **o),
    "stdout": lambda df, o: show_lines(df, **o) and None,
}

#: Outputs that take or drop whole messages instead of single questions.
MESSAGE_SINKS = {"kafka"}


#: Outputs that own a folder, ``path``, where a block of a stream can be replaced.
BLOCK_SINKS = {"parquet", "file", "log", "frames"}


def register_sink(name: str, write: Sink, whole_messages: bool = False, blocks: bool = False) -> None:
    """Add an output: a function of (results, options) that stores a finite DataFrame.

    ``blocks`` tells that it takes ``path`` and ``mode`` and can replace what is there.
    """
    SINKS[name] = write
    (MESSAGE_SINKS.add if whole_messages else MESSAGE_SINKS.discard)(name)
    (BLOCK_SINKS.add if blocks else BLOCK_SINKS.discard)(name)


def write_to(results: DataFrame, name: str, options: dict) -> None:
    if name not in SINKS:
        raise ValueError(f"{name} is not a known output")
    SINKS[name](results, options)
