"""Reassembly on streams: state per flow, forgotten or flushed after inactivity.

Many flows share a group of the stream, dealt out by the hash of their keys, so that a group's rows, state
and output cross to Python in a few Arrow batches. A state of its own costs a flow ten round trips.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from namestrata.operators.reassembly import (
    FLOW,
    FRAGMENT_KEY,
    GC_SECONDS,
    SYN,
    FragmentTrain,
    sane_fragments,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

KEYS = {
    "file": "file STRING", "ip_version": "ip_version INT", "src_ip": "src_ip BINARY",
    "dst_ip": "dst_ip BINARY", "ip_id": "ip_id BIGINT", "key_protocol": "key_protocol INT",
    "src_port": "src_port INT", "dst_port": "dst_port INT",
}
SEQ = itemgetter(0)
FRAGMENT_OUT = "seq BIGINT, ts_ns BIGINT, protocol_no INT, payload BINARY"
TCP_OUT = "seq BIGINT, ts_ns BIGINT, payload BINARY"


class _Keyed(StatefulProcessor):
    """State of one key as a single value, with an expiry timer moved on by every batch: the steps of the
    groups for ``transformWithState``, where a stream has few keys.

    Every call on the handle is a round trip to the JVM, so a key's value is fetched once and what
    was found is handed on.
    """

    fields: tuple[str, ...] = ()

    def __init__(self, keys: list[str], gc_ms: int):
        self.keys, self.gc_ms = keys, gc_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("flow", "data BINARY, expires BIGINT")

    def load(self):
        """(state, time of its timer), both None for a new key."""
        found = self.value.get()
        return (pickle.loads(found[0]), found[1]) if found is not None else (None, None)

    def store(self, data, last_ms: int, timer: int | None) -> None:
        """Keep state and set its timer; ``timer``, the one of an earlier batch, is replaced."""
        expires = last_ms + self.gc_ms
        self.value.update((pickle.dumps(data), expires))
        if timer != expires:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(expires)

    def forget(self, timer: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
            self.value.clear()

    def rows(self, key, made: list[tuple]):
        """Output rows: the key's columns, then the processor's own."""
        for values in made:
            yield Row(**dict(zip([*self.keys, *self.fields], [*key, *values])))

    def close(self) -> None:
        pass


class Fragments(_Keyed):
    fields = ("seq", "ts_ns", "protocol_no", "payload")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        found, timer = self.load()
        batch = [(r.seq, r.ts_ns, r.frag_offset, r.more_fragments, r.protocol_no, bytes(r.payload)) for r in rows]
        batch.sort(key=SEQ)
        out, left = fragment_train(found, batch)
        if left:
            self.store(left, max(r[1] for r in batch) // 1_000_000, timer)
        else:
            self.forget(timer)
        yield from self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        # The rest of an unfinished train is dropped.
        self.value.clear()
        yield from self.rows(key, [])


class TcpStream:
    """Bytes of one direction of a flow, handed out as length-prefixed messages."""

    def __init__(self):
        self.next: int | None = None
        self.waiting: dict[int, bytes] = {}
        self.tail = b""
        self.began: tuple[int, int] | None = None

    def add(self, seq: int, ts_ns: int, number: int, syn: bool, payload: bytes) -> list[tuple]:
        out = []
        if syn:
            out = self.flush()
            self.__init__()
            self.next = (number + 1) % (1 << 32)
        if self.began is None:
            self.began = (seq, ts_ns)
        if payload:
            held = self.waiting.get(number, b"")
            self.waiting[number] = max(held, payload, key=len)
        return out + self._deliver()

    def _distance(self, number: int) -> int:
        return (number - self.next + (1 << 31)) % (1 << 32) - (1 << 31)

    def _deliver(self) -> list[tuple]:
        # Without a SYN the first number is unknown until the stream is flushed.
        moved = self.next is not None
        while moved:
            moved = False
            for number in sorted(self.waiting, key=self._distance):
                ahead = self._distance(number)
                if ahead > 0:
                    break
                payload = self.waiting.pop(number)[-ahead:]
                if payload:
                    self.tail += payload
                    self.next = (self.next + len(payload)) % (1 << 32)
                    moved = True
                    break
        return self._messages()

    def _messages(self) -> list[tuple]:
        out, at = [], 0
        while len(self.tail) - at >= 2:
            size = int.from_bytes(self.tail[at : at + 2], "big") + 2
            if len(self.tail) - at < size:
                break
            out.append((*self.began, self.tail[at + 2 : at + size]))
            at += size
        self.tail = self.tail[at:]
        return out

    def flush(self) -> list[tuple]:
        """Hand out everything still waiting, closing up holes."""
        out = []
        while self.waiting:
            if self.next is None:
                anchor = next(iter(self.waiting))
                self.next = anchor
            self.next = min(self.waiting, key=self._distance)
            out += self._deliver()
        return out


class Segments(_Keyed):
    fields = ("seq", "ts_ns", "payload")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        found, timer = self.load()
        batch = [(r.seq, r.ts_ns, r.tcp_seq, r.tcp_flags, bytes(r.payload)) for r in rows]
        batch.sort(key=SEQ)
        out, left = tcp_flow(found, batch)
        self.store(left, max(r[1] for r in batch) // 1_000_000, timer)
        yield from self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        found, _ = self.load()
        self.value.clear()
        yield from self.rows(key, flush_flow(found) if found else [])


# --- steps of one key: (state or None, rows in the order of seq) to (output, state or None) --------


def fragment_train(held, rows: Iterable[tuple]) -> tuple[list[tuple], tuple | None]:
    pieces, final = held or ((), False)
    train, out = FragmentTrain(dict(pieces), final), []
    for seq, ts_ns, offset, more, protocol, payload in rows:
        data = train.add(offset, more, payload)
        if data is not None:
            out.append((seq, ts_ns, protocol, data))
    return out, (sorted(train.held.items()), train.final) if train.held else None


def drop_train(held) -> list[tuple]:
    """The rest of an unfinished train is dropped."""
    return []


def _stream_of(held) -> TcpStream:
    stream = TcpStream()
    if held:
        stream.next, waiting, stream.tail, stream.began = held
        stream.waiting = dict(waiting)
    return stream


def tcp_flow(held, rows: Iterable[tuple]) -> tuple[list[tuple], tuple]:
    stream, out = _stream_of(held), []
    for seq, ts_ns, number, flags, payload in rows:
        out += stream.add(seq, ts_ns, number, bool(flags & SYN), payload)
    return out, (stream.next, tuple(stream.waiting.items()), stream.tail, stream.began)


def flush_flow(held) -> list[tuple]:
    return _stream_of(held).flush()


# --- groups of keys ----------------------------------------------------------------------------

#: Keys are dealt out to so many groups.
GROUPS = 2048


def grouped(
    keys: list[str], fields: list[str], outputs: list[str], step: Callable, expire: Callable, gc_ms: int
) -> Callable:
    """A function for ``applyInPandasWithState`` over groups of keys.

    The state is every key's own state and the time it expires, ``gc_ms`` after the newest row it saw last. A
    group's timeout is the first of these times. Keys whose time the watermark has passed are handed
    to ``expire``, after the rows of the batch, which may have moved it on.
    """

    def run(group, frames, state: GroupState):
        held = pickle.loads(state.get[0]) if state.exists else {}
        batches: dict[tuple, list] = {}
        if not state.hasTimedOut:
            for frame in frames:
                own = zip(*[_values(frame[k]) for k in keys])
                for key, row in zip(own, zip(*[_values(frame[c]) for c in fields])):
                    batches.setdefault(key, []).append(row)
        made = []
        for key, rows in batches.items():
            rows.sort(key=SEQ)
            out, left = step(held[key][0] if key in held else None, rows)
            made += [(*key, *values) for values in out]
            if left:
                held[key] = left, max(r[1] for r in rows) // 1_000_000 + gc_ms
            else:
                held.pop(key, None)
        watermark = state.getCurrentWatermarkMs()
        for key in [k for k, (_, expires) in held.items() if expires < watermark and k not in batches]:
            made += [(*key, *values) for values in expire(held.pop(key)[0])]
        if held:
            state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
            # Spark takes no timeout before the watermark or the epoch.
            state.setTimeoutTimestamp(max(1, watermark, min(expires for _, expires in held.values())))
        elif state.exists:
            state.remove()
        if made:
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip([*keys, *outputs], zip(*made))})

    return run


def _values(column: pd.Series) -> list:
    """Whole numbers, some of them missing, come from Spark as fractions."""
    if column.dtype.kind == "f":
        return [None if v != v else int(v) for v in column.tolist()]
    return column.tolist()


def _run(
    rows: DataFrame, keys: list[str], inputs: list[str], step: Callable, expire: Callable, out: str, gc_seconds: int, late: str
) -> DataFrame:
    rows.sparkSession.conf.set(PROVIDER, ROCKSDB)
    schema = ", ".join([*(KEYS[k] for k in keys), out])
    outputs = [f.split()[0] for f in out.split(", ")]
    run = grouped(keys, ["seq", "ts_ns", *inputs], outputs, step, expire, gc_seconds * 1000)
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int")
    # Nanoseconds since the epoch, in which rows and pandas count, end there; later rows, as an end row, come last.
    first, last = F.lit("1677-09-22").cast("timestamp"), F.lit("2262-04-11").cast("timestamp")
    at = F.when(F.col("ts") > last, last).when(F.col("ts") < first, first).otherwise(F.col("ts"))
    # Every column of a row goes through the shuffle and to Python, so only those read there stay.
    return (
        rows.select(group.alias("group"), *keys, at.alias("at"), "seq", "ts_ns", *inputs)
        .withWatermark("at", late)
        .groupBy("group")
        .applyInPandasWithState(run, schema, "held BINARY", "append", GroupStateTimeout.EventTimeTimeout)
        .withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000")))
    )


def reassemble_fragments_stream(
    datagrams: DataFrame, gc_seconds: int = GC_SECONDS, late: str = "10 seconds"
) -> DataFrame:
    """Streaming form of fragment reassembly; unfinished trains expire in event time."""
    rows = sane_fragments(datagrams).withColumn("file", F.coalesce("file", F.lit("")))
    inputs = ["frag_offset", "more_fragments", "protocol_no", "payload"]
    out = _run(rows, FRAGMENT_KEY, inputs, fragment_train, drop_train, FRAGMENT_OUT, gc_seconds, late)
    return out.drop("ip_id", "key_protocol")


def tcp_messages_stream(
    segments: DataFrame, gc_seconds: int = GC_SECONDS, late: str = "10 seconds"
) -> DataFrame:
    """Streaming form of TCP reassembly; idle flows are flushed in event time."""
    rows = segments.withColumn("file", F.coalesce("file", F.lit("")))
    inputs = ["tcp_seq", "tcp_flags", "payload"]
    return _run(rows, FLOW, inputs, tcp_flow, flush_flow, TCP_OUT, gc_seconds, late)
