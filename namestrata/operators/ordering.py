"""Order-dependent building blocks that never put one group into one task.

The capture pipeline depends on arrival order: record numbers, inactivity gaps, running
state. A plain window over a capture file or a flow would sort that whole group in
one task. Here every group is first cut into small ranges of its order column; the
ranges are summarised by a partial aggregation, the summaries are ordered, and rows
only ever meet within their own range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = 1_000_000


def arrival_number(
    df: DataFrame, order: str = "seq", by: tuple[str, ...] = (), width: int = RANGE, out: str = "n"
) -> DataFrame:
    """Add the 1-based position of each row in ``order`` within ``by``, exactly.

    ``order`` is a unique BIGINT, so a range of ``width`` values holds at most ``width``
    rows. Range sizes are summed up front and give each range its starting position.
    """
    part = "__range"
    ranged = df.withColumn(part, F.expr(f"`{order}` div {width}"))
    keys = [*by, part]
    sizes = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"__at_{k}") for k in keys],
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    numbered = ranged.withColumn("__inside", inside)
    return numbered.join(starts, same_keys(keys), "left").select(
        *df.columns, (F.col("__start") + F.col("__inside")).alias(out)
    )


def same_keys(keys: list[str]) -> list:
    """Join condition of ``key`` with its copy ``__at_key``; NULL keys count as equal."""
    return [F.col(k).eqNullSafe(F.col(f"__at_{k}")) for k in keys]


def sessions(
    df: DataFrame,
    by: tuple[str, ...],
    time_us: str,
    gap_us: int,
    starts: str | None = None,
    order: str = "seq",
) -> DataFrame:
    """Add ``session`` (BIGINT): a new one starts after ``gap_us`` of inactivity.

    Rows are summarised per (key, time slot of one gap, range of ``order``). Two rows in one
    slot can never be more than a gap apart, so a session is a run of whole slots and only
    the summaries need ordering. ``starts`` optionally names a BOOLEAN column whose true rows
    also open a session; those are numbered inside their summary's rows, of which the order
    range bounds the count. Keys must not be NULL.
    """
    keys = [*by, "__slot", "__range"]
    slotted = df.withColumn("__slot", F.expr(f"`{time_us}` div {gap_us}"))
    slotted = slotted.withColumn("__range", F.expr(f"`{order}` div {RANGE}"))
    opened = F.count_if(starts) if starts else F.lit(0).cast("bigint")
    summary = slotted.groupBy(*keys).agg(
        F.min(time_us).alias("__first"), F.max(time_us).alias("__last"), opened.alias("__opened")
    )
    timeline = Window.partitionBy(*by).orderBy("__slot", "__range")
    idle = F.col("__first") - F.lag("__last").over(timeline) > F.lit(gap_us)
    summary = summary.withColumn("__idle", F.when(idle, 1).otherwise(0))
    upto = timeline.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = timeline.rowsBetween(Window.unboundedPreceding, -1)
    opened_before = F.coalesce(F.sum("__opened").over(before), F.lit(0))
    summary = summary.select(
        *keys, (F.sum("__idle").over(upto) + opened_before).alias("__base")
    )
    inner = F.lit(0).cast("bigint")
    if starts:
        within = Window.partitionBy(*keys).orderBy(time_us, order)
        inner = F.count_if(starts).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return (
        slotted.withColumn("__inner", inner)
        .join(summary, keys)
        .select(*df.columns, (F.col("__base") + F.col("__inner")).alias("session"))
    )


def chunk_numbers(df: DataFrame, by: list[str], range_column: str, first: str | None = None) -> DataFrame:
    """Add ``chunk``: the ranges a group occupies, numbered 0, 1, 2 … without holes.

    With ``first``, also ``next_first``: the least ``first`` value of the group's next chunk.
    """
    keys = [*by, range_column]
    least = F.min(first) if first else F.lit(None)
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), least.alias("__least"))
    line = Window.partitionBy(*by).orderBy(range_column)
    extra = [F.lead("__least").over(line).alias("next_first")] if first else []
    found = found.select(
        *keys,
        (F.row_number().over(line) - 1).cast("bigint").alias("chunk"),
        *extra,
    )
    added = ["chunk", *(["next_first"] if first else [])]
    return df.join(found, keys).select(*df.columns, *added)
