"""Queries over the flat log and its rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namestrata.functions.timing import five_minutes, truncate


def as_time(as_of: str | Column | None) -> Column:
    if as_of is None:
        return F.current_timestamp()
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


def since(df: DataFrame, column: str, as_of, hours: int, day_column: str | None = None) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``.

    ``day_column`` names the partition column; the same bound on it prunes folders.
    """
    bound = as_time(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    if day_column:
        df = df.filter(F.col(day_column) >= bound.cast("date"))
    return df.filter(F.col(column) > bound)


def new_domains(
    log: DataFrame, as_of=None, recent_days: int = 1, baseline_days: int = 10, day_column: str | None = None
) -> DataFrame:
    """Questions of the recent days that the baseline days before did not have.

    One scan: each name is reduced to whether either span has it before the shuffle. The bounds
    stand on the bare time, and on ``day_column`` where the log is partitioned by one, so older
    files and folders are not read.
    """
    now = as_time(as_of)
    day = truncate(log, "PacketTime", "day")
    recent_from = now - F.expr(f"INTERVAL {int(recent_days)} DAYS")
    base_from = now - F.expr(f"INTERVAL {int(baseline_days)} DAYS")
    # A day after the bound begins after it, so its rows are later than the bound too.
    rows = log.filter((F.col("PacketTime") > base_from) & F.col("Question").isNotNull())
    if day_column:
        rows = rows.filter(F.col(day_column) >= base_from.cast("date"))
    spans = rows.groupBy("Question").agg(
        F.max(day > recent_from).alias("recent"), F.max((day < recent_from) & (day > base_from)).alias("before")
    )
    return spans.filter("recent AND NOT before").select("Question")


def request_timeline(log: DataFrame) -> DataFrame:
    """Requests per five minutes in time order."""
    return (
        log.groupBy(five_minutes(log, "PacketTime").alias("t"))
        .agg(F.count(F.lit(1)).alias("c"))
        .orderBy("t")
    )


def distinct_domains(domain_count: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    """Names seen in the last hours, from the domain-count rollup, whose day prunes its folders."""
    return since(domain_count, "t", as_of, hours, "DnsDate").select("Question").distinct()


def count_distinct_domains(
    domain_count: DataFrame, as_of=None, hours: int = 24, approximate: bool = False
) -> DataFrame:
    rows = since(domain_count, "t", as_of, hours, "DnsDate")
    measure = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(measure("Question").alias("domains"))


def top_domains(domain_count: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most requested names; ties go to the alphabetically first."""
    totals = domain_count.groupBy("Question").agg(F.sum("c").alias("c"))
    return totals.orderBy(F.desc("c"), "Question").limit(k)
