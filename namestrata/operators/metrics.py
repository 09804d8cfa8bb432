"""Counters of a job: observed while rows flow, or aggregated from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observe_counts(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """Count rows and rows that meet each condition, without another pass over the data."""
    watch = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.count_if(c).alias(n) for n, c in conditions.items()]
    return df.observe(watch, *counts), watch


def loss_percent(dropped: Column, captured: Column) -> Column:
    """Dropped share in percent; NULL when nothing was captured."""
    return F.try_divide(dropped.cast("double") * 100.0, captured.cast("double"))


def decoding_counts(decoded: DataFrame) -> DataFrame:
    """One row: all rows, header errors (``layer_error``) and their share, and apart from these the
    messages that could not be unpacked (``error``)."""
    broken, unread = F.col("layer_error").isNotNull(), F.col("error").isNotNull()
    out = decoded.agg(
        F.count(F.lit(1)).alias("packetsCaptured"),
        F.count_if(broken).alias("decodingErrors"),
        F.count_if(~broken & unread).alias("unpackErrors"),
    )
    return out.withColumn("errorPercent", loss_percent(F.col("decodingErrors"), F.col("packetsCaptured")))


def metrics_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("value"))


def metrics_pairs(metrics: DataFrame) -> DataFrame:
    """``name=value`` pairs in name order, each followed by a blank."""
    pairs = [F.concat(F.lit(f"{c}="), F.col(c).cast("string"), F.lit(" ")) for c in sorted(metrics.columns)]
    return metrics.select(F.concat(*pairs).alias("value"))
