"""Timestamp helpers that keep the column's own type (TIMESTAMP or TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"ms": "MILLISECOND", "second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY"}


def time_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def truncate(df: DataFrame, column: str, grain: str) -> Column:
    """``column`` cut to ``grain`` (ms, second, minute, hour, day)."""
    return F.date_trunc(UNITS[grain], F.col(column)).cast(time_type(df, column))


def five_minutes(df: DataFrame, column: str) -> Column:
    return F.window(F.col(column), "5 minutes")["start"].cast(time_type(df, column))


def nanos(ts: Column) -> Column:
    """Epoch nanoseconds of a TIMESTAMP (microsecond precision)."""
    return F.unix_micros(ts) * F.lit(1000).cast("bigint")


def rfc3339(ts: Column, ts_ns: Column) -> Column:
    """UTC text with as many fraction digits as needed, up to nanoseconds."""
    fraction = F.rtrim(
        F.lpad(F.pmod(ts_ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("0")
    )
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))
