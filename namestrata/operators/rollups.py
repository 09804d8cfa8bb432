"""The eleven rollups of the flat log, as one table-driven aggregation.

Each rollup is described by its row filter, its keys, its measures and the grain of
its time column. Measures are stored as mergeable partial states (sums, counts,
sketches), so partial rollups from any number of blocks add up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namestrata.functions.timing import truncate

HLL_BITS = 12


@dataclass(frozen=True)
class Rollup:
    """``grain`` is the precision of the time column; ``where`` filters log rows."""

    table: str
    time_name: str
    grain: str
    keys: tuple[str, ...] = ()
    where: str | None = None
    counts: bool = True
    sums: dict[str, str] = field(default_factory=dict)
    averages: dict[str, str] = field(default_factory=dict)
    distinct: dict[str, str] = field(default_factory=dict)


QUERIES, RESPONSES = "QR = 0", "QR = 1"

ROLLUPS = {
    "domain_count": Rollup("DNS_DOMAIN_COUNT", "t", "minute", ("Question",), QUERIES),
    "domain_unique": Rollup(
        "DNS_DOMAIN_UNIQUE", "timestamp", "ms", (), QUERIES, False,
        distinct={"UniqueDnsCount": "Question"},
    ),
    "protocol": Rollup("DNS_PROTOCOL", "timestamp", "minute", ("Protocol",)),
    "general": Rollup(
        "DNS_GENERAL_AGGREGATIONS", "timestamp", "ms", (), None, False,
        sums={"TotalSize": "Size"}, averages={"AverageSize": "Size"},
    ),
    "edns": Rollup(
        "DNS_EDNS", "timestamp", "ms", (), QUERIES, False,
        sums={"EdnsCount": "Edns0Present", "DoBitCount": "DoBit"},
    ),
    "opcode": Rollup("DNS_OPCODE", "timestamp", "ms", ("OpCode",), QUERIES),
    "type": Rollup("DNS_TYPE", "timestamp", "second", ("Type",), QUERIES),
    "class": Rollup("DNS_CLASS", "timestamp", "second", ("Class",), QUERIES),
    "response": Rollup("DNS_RESPONSECODE", "timestamp", "second", ("ResponseCode",), RESPONSES),
    "srcip": Rollup("DNS_SRCIP_MASK", "timestamp", "second", ("IPVersion", "SrcIP")),
    "dstip": Rollup("DNS_DSTIP_MASK", "timestamp", "second", ("IPVersion", "DstIP")),
}


def _prepare(log: DataFrame, spec: Rollup, grain: str | None) -> tuple[DataFrame, list[str]]:
    rows = log.filter(spec.where) if spec.where else log
    rows = rows.withColumn("DnsDate", F.to_date("PacketTime")).withColumn(
        spec.time_name, truncate(rows, "PacketTime", grain or spec.grain)
    )
    return rows, ["DnsDate", spec.time_name, "Server", *spec.keys]


def rollup(log: DataFrame, name: str, grain: str | None = None, exact: bool = True) -> DataFrame:
    """Final rollup values. ``exact`` picks count-distinct over the sketch estimate."""
    spec = ROLLUPS[name]
    if not exact and spec.distinct:
        return finalize(partial_rollup(log, name, grain), name)
    rows, keys = _prepare(log, spec, grain)
    out: list[Column] = []
    if spec.counts:
        out.append(F.count(F.lit(1)).alias("c"))
    out += [F.sum(src).alias(dst) for dst, src in spec.sums.items()]
    out += [F.avg(src).alias(dst) for dst, src in spec.averages.items()]
    out += [F.count_distinct(src).alias(dst) for dst, src in spec.distinct.items()]
    return rows.groupBy(*keys).agg(*out)


def state_columns(spec: Rollup, merge: bool) -> list[Column]:
    """Partial states of a rollup: built from log rows, or merged from earlier states."""
    out: list[Column] = []
    if spec.counts:
        out.append((F.sum("c") if merge else F.count(F.lit(1))).alias("c"))
    for dst, src in spec.sums.items():
        out.append(F.sum(dst if merge else src).cast("bigint").alias(dst))
    for dst, src in spec.averages.items():
        total, rows = f"{dst}_sum", f"{dst}_count"
        out.append(F.sum(total if merge else src).cast("bigint").alias(total))
        out.append((F.sum(rows) if merge else F.count(src)).alias(rows))
    for dst, src in spec.distinct.items():
        state = F.hll_union_agg(dst) if merge else F.hll_sketch_agg(src, HLL_BITS)
        out.append(state.alias(dst))
    return out


def partial_rollup(log: DataFrame, name: str, grain: str | None = None) -> DataFrame:
    """Mergeable states of one block of rows (sketch, sum, sum+count)."""
    spec = ROLLUPS[name]
    rows, keys = _prepare(log, spec, grain)
    return rows.groupBy(*keys).agg(*state_columns(spec, merge=False))


def merge_rollup(parts: DataFrame, name: str, grain: str | None = None) -> DataFrame:
    """Merge partial rows that share a key, optionally to a coarser grain."""
    spec = ROLLUPS[name]
    if grain:
        parts = parts.withColumn(spec.time_name, truncate(parts, spec.time_name, grain))
    keys = ["DnsDate", spec.time_name, "Server", *spec.keys]
    return parts.groupBy(*keys).agg(*state_columns(spec, merge=True))


def finalize(states: DataFrame, name: str) -> DataFrame:
    """Turn merged states into values: weighted average, distinct estimate."""
    spec = ROLLUPS[name]
    out = states
    for dst in spec.averages:
        out = out.withColumn(dst, F.try_divide(F.col(f"{dst}_sum"), F.col(f"{dst}_count")))
        out = out.drop(f"{dst}_sum", f"{dst}_count")
    for dst in spec.distinct:
        out = out.withColumn(dst, F.hll_sketch_estimate(dst))
    return out


def register_views(log: DataFrame) -> None:
    """Expose the log and every rollup to ``spark.sql`` under their table names."""
    log.createOrReplaceTempView("DNS_LOG")
    for name, spec in ROLLUPS.items():
        rollup(log, name).createOrReplaceTempView(spec.table)
