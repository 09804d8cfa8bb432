"""Record sampling ``A:B``, packet de-duplication and per-flush limits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namestrata.operators.counters import Counters, watched
from namestrata.operators.ordering import RANGE, arrival_number, same_keys

MODES = ("reference_packet", "reference_dnstap", "exact")


def parse_ratio(text: str) -> tuple[int, int]:
    """``"A:B"`` with whole numbers and A not above B."""
    parts = text.split(":")
    if len(parts) != 2:
        raise ValueError(f"wrong sample ratio {text!r}")
    a, b = int(parts[0]), int(parts[1])
    if a > b or a < 0 or b < 1:
        raise ValueError(f"wrong sample ratio {text!r}")
    return a, b


def sample_condition(n: Column, a: int, b: int, mode: str = "reference_packet") -> Column:
    """Whether the record with 1-based arrival number ``n`` is kept.

    The two reference modes are closed forms of a counter that restarts itself; the
    position inside its period decides. ``exact`` keeps A of every B.
    """
    if mode not in MODES:
        raise ValueError(f"unknown sampling mode {mode!r}")
    if a == b:
        return F.lit(True)
    if mode == "exact":
        return (n - 1) % b < a
    if mode == "reference_packet":
        if a == b - 1:
            return F.lit(True)
        period = a * b + a + 1
        return ((n - 1) % period + 1) % b <= a
    if a == 0:
        return F.lit(False)
    period = 2 * b if a == 1 else a * b + 1
    return ((n - 1) % period + 1) % b < a


def sample_records(
    df: DataFrame,
    ratio: str,
    mode: str = "reference_packet",
    order: str = "seq",
    by: tuple[str, ...] = (),
    number: str | None = None,
    counters: Counters | None = None,
) -> DataFrame:
    """Keep the sampled records. The counter runs per ``by`` (one capture each).

    ``number`` names a column that already holds the 0-based record number in its
    capture, as the capture sources produce it; then no shuffle is needed at all.
    """
    a, b = parse_ratio(ratio)
    rows, n = df, F.col("__n")
    if number:
        n = F.col(number) + 1
    else:
        rows = arrival_number(df, order, by, out="__n")
    kept = sample_condition(n, a, b, mode)
    rows = watched(counters, rows, packetsCaptured=F.lit(True), packetsOverRatio=~kept)
    return rows.filter(kept).select(*df.columns)


# The 64-bit FNV-1a offset basis and prime.
FNV_BASIS = np.uint64(0xCBF29CE484222325)
FNV_PRIME = np.uint64(0x100000001B3)


@F.pandas_udf(T.LongType())
def fnv1a64(data: pd.Series) -> pd.Series:
    """64-bit FNV-1a of each value, as the signed number with the same bits.

    All rows advance one byte per step, so a batch costs as many numpy steps as its
    longest value has bytes.
    """
    values = data.to_list()
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(values), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    begin, ordered = begin[order], sizes[order]
    state = np.full(len(values), FNV_BASIS, dtype=np.uint64)
    live = len(values)
    with np.errstate(over="ignore"):
        for step in range(int(ordered[0]) if len(values) else 0):
            while ordered[live - 1] <= step:
                live -= 1
            head = state[:live]
            head ^= flat[begin[:live] + step]
            head *= FNV_PRIME
    out = np.empty(len(values), dtype=np.uint64)
    out[order] = state
    return pd.Series(out.view(np.int64))


def packet_hash(data: Column, exact: bool = False) -> Column:
    """Hash that identifies copies: FNV-1a when ``exact``, else a JVM-side 64-bit hash."""
    return fnv1a64(data) if exact else F.xxhash64(data)


def mark_copies(
    packets: DataFrame,
    seconds: int = 60,
    data: str = "data",
    time: str = "ts",
    order: str = "seq",
    by: tuple[str, ...] = (),
    exact_hash: bool = False,
    out: str = "is_copy",
) -> DataFrame:
    """Add ``out``: whether an equal packet of a smaller order is in the same tumbling window.

    ``order`` is unique within ``by``. Only the keys are aggregated, to the least order of
    those that occur more than once; a packet repeated a billion times costs one row per task
    there. The packets meet these keys in a join, which adaptive execution turns into a
    broadcast where the copies are few and splits where one key is hot.
    """
    columns = packets.columns
    slot = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(seconds * 1_000_000))
    keyed = packets.withColumns({"__slot": slot, "__hash": packet_hash(F.col(data), exact_hash)})
    keys = [*by, "__slot", "__hash"]
    counted = keyed.groupBy(*keys).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    firsts = counted.filter("__n > 1").select(*[F.col(k).alias(f"__at_{k}") for k in keys], "__first")
    joined = keyed.join(firsts, same_keys(keys), "left")
    copy = F.col("__first").isNotNull() & (F.col(order) != F.col("__first"))
    return joined.select(*columns, copy.alias(out))


def drop_copies(packets: DataFrame, seconds: int = 60, **options) -> DataFrame:
    """Keep the first copy of equal packets per tumbling window, see :func:`mark_copies`."""
    return mark_copies(packets, seconds, out="__copy", **options).filter("NOT __copy").select(*packets.columns)


def sample_then_drop_copies(
    packets: DataFrame, ratio: str, mode: str = "reference_packet", order: str = "seq",
    number: str | None = None, counters: Counters | None = None, **dedup,
) -> DataFrame:
    """Both steps as the packet path applies them.

    The copy table also sees packets the sampler rejected, so a rejected first copy
    hides its later copies. A packet may count as sampled out and as a copy.
    """
    a, b = parse_ratio(ratio)
    by = dedup.get("by", ())
    rows = packets
    n = F.col(number) + 1 if number else F.col("__n")
    if not number:
        rows = arrival_number(rows, order, by, out="__n")
    rows = rows.withColumn("__kept", sample_condition(n, a, b, mode))
    rows = mark_copies(rows, order=order, out="__copy", **dedup)
    rows = watched(
        counters, rows, packetsCaptured=F.lit(True), packetsOverRatio=~F.col("__kept"), packetsDuplicate=F.col("__copy")
    )
    return rows.filter("__kept AND NOT __copy").select(*packets.columns)


def limit_per_flush(
    df: DataFrame, limit: int, flush: str, order: str = "seq", by: tuple[str, ...] = ()
) -> DataFrame:
    """At most ``limit`` rows per flush, the earliest first; 0 means no limit.

    Rows are numbered by ranges of ``order``, a BIGINT that is unique within ``by`` and flush, so
    a flush of any length is never one task's work.
    """
    if limit < 0:
        raise ValueError("the packet limit cannot be negative")
    if limit == 0:
        return df
    numbered = arrival_number(df, order, (*by, flush), out="__n")
    return numbered.filter(F.col("__n") <= limit).drop("__n")


def flush_number(
    df: DataFrame, size: int, order: str = "seq", out: str = "batch", width: int = RANGE
) -> DataFrame:
    """Number of the flush each row falls into when every ``size`` rows are flushed."""
    numbered = arrival_number(df, order, width=width, out="__n")
    return numbered.withColumn(out, F.expr(f"(__n - 1) div {size}")).drop("__n")
