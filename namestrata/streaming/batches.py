"""Batches of a stream by size and by delay, kept as state."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from namestrata.session import shared_dir
from namestrata.streaming.reassembly import PROVIDER, ROCKSDB


class Batcher(StatefulProcessor):
    """Rows of one key that wait for their batch: its number, a timer, and at most ``size`` texts.

    A batch is full at ``size`` rows. With a delay, what waits is handed out that long after its
    first row, however few they are.
    """

    def __init__(self, key: str, size: int, delay_ms: int):
        self.key, self.size, self.delay_ms = key, size, delay_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "value STRING")
        self.batch = handle.getValueState("batch", "number BIGINT, due BIGINT")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        number, due = self.batch.get() if self.batch.exists() else (0, None)
        held = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        for r in rows:
            held.append(r.value)
            if len(held) == self.size:
                yield self._row(key, number, held)
                number, held = number + 1, []
                due = self._cancel(due)
        if held:
            self.waiting.put([(v,) for v in held])
            if self.delay_ms and due is None:
                due = timerValues.getCurrentProcessingTimeInMs() + self.delay_ms
                self.handle.registerTimer(due)
        else:
            self.waiting.clear()
        self.batch.update((number, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        number, _ = self.batch.get() if self.batch.exists() else (0, None)
        held = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        if held:
            yield self._row(key, number, held)
            number += 1
        self.waiting.clear()
        self.batch.update((number, None))

    def _cancel(self, due):
        if due is not None:
            self.handle.deleteTimer(due)

    def _row(self, key, number: int, held: list[str]) -> Row:
        return Row(**{self.key: key[0], "batch": number, "rows": len(held), "value": "\n".join(held)})

    def close(self) -> None:
        pass


def batches_stream(rows: DataFrame, key: str, size: int, delay_seconds: float = 0) -> DataFrame:
    """``key, batch, rows, value``: the texts ``value`` of every ``size`` rows of a key, one per line.

    The rest of a key comes out ``delay_seconds`` after its first row, at the next micro-batch; without
    a delay it waits for more rows. What is kept per key is less than one batch. A key is one
    task's work, so a stream without a natural one is dealt out by a hash.
    """
    if size < 1:
        raise ValueError("a batch holds at least one record")
    rows.sparkSession.conf.set(PROVIDER, ROCKSDB)
    kind = rows.schema[key].dataType.simpleString()
    processor = Batcher(key, size, int(delay_seconds * 1000))
    schema = f"{key} {kind}, batch BIGINT, rows INT, value STRING"
    return rows.select(key, "value").groupBy(key).transformWithState(processor, schema, "Append", "ProcessingTime")



def run_until_flushed(batches: DataFrame, purpose: str, delay_seconds: float, patience: float = 60) -> DataFrame:
    """Run a stream of batches until a micro-batch without data began ``delay_seconds`` after the last
    one with data, so that nothing waits any more, and read the outcome back as a table.

    Timers on the clock ask for one micro-batch after another, so such a stream never ends by itself.
    Without any data within ``patience`` seconds it is stopped as well.
    """
    spark = batches.sparkSession
    folder = shared_dir(spark, purpose)
    writer = batches.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.trigger(processingTime="0 seconds").start(f"{folder}/rows")
    # A timer is set while its micro-batch runs, so that time counts too.
    last, took, began = None, 0.0, time.monotonic()
    try:
        while query.isActive:
            for p in query.recentProgress:
                at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
                if p.numInputRows:
                    last, took = max(last or at, at), max(took, p.durationMs.get("triggerExecution", 0) / 1000)
                elif last and at >= last + timedelta(seconds=delay_seconds + took):
                    return spark.read.schema(batches.schema).parquet(f"{folder}/rows")
            if last is None and time.monotonic() - began > patience:
                break
            time.sleep(0.2)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    return spark.read.schema(batches.schema).parquet(f"{folder}/rows")
