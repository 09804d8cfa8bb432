"""Streams whose keys share state: as many state rows as groups, the rows of a state per key."""

import random

import pandas as pd
import pytest
from pyspark.sql import Row

from namestrata.operators import headers
from namestrata.operators.reassembly import FLOW, FRAGMENT_KEY
from namestrata.plans import traffic
from namestrata.streaming import jobs, reassembly
from namestrata.streaming.reassembly import Fragments, Segments
from tests.conftest import SF
from tests.test_streams import Handle

GC_MS = 10_000


def stream_of(spark, made):
    events = jobs.read_folder(spark, SF, traffic.load_events(spark, SF).schema, names="events.parquet")
    return headers.ip_datagrams(made(events))


@pytest.mark.parametrize("kind", ["tcp", "fragments"])
def test_state_has_a_row_per_group(spark, tmp_path, monkeypatch, kind):
    """A thousand flows or trains in four groups: the state they leave is four rows at most."""
    monkeypatch.setattr(reassembly, "GROUPS", 4, raising=False)
    if kind == "tcp":
        segments = headers.on_port(headers.transport(stream_of(spark, traffic.tcp_packets_of)))
        out = reassembly.tcp_messages_stream(segments)
    else:
        out = reassembly.reassemble_fragments_stream(stream_of(spark, traffic.fragment_packets_of))
    query = (
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True).start(f"{tmp_path}/rows")
    )
    query.awaitTermination()
    first = query.recentProgress[0]["stateOperators"][0]
    assert 0 < first["numRowsTotal"] <= 4
    events = traffic.load_events(spark, SF).count()
    whole = traffic.load_events(spark, SF).filter("event_id % 29 <> 0").count()
    assert spark.read.parquet(f"{tmp_path}/rows").count() == (3 * events if kind == "tcp" else whole)


class Held:
    """A group's state in memory."""

    def __init__(self):
        self.value, self.timeout, self.watermark, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.timeout = None

    def setTimeoutTimestamp(self, at):  # noqa: N802
        assert at > 0 and at >= self.watermark
        self.timeout = at


def per_key(kind, keys, batches):
    """What the processor of one key makes of the micro-batches, its timers fired after each."""
    processors, out = {}, []
    for watermark, rows in batches:
        made = []
        for key in dict.fromkeys(tuple(r[k] for k in keys) for r in rows):
            if key not in processors:
                handle, processor = Handle(), kind(keys, GC_MS)
                processor.init(handle)
                processors[key] = handle, processor
            own = [r for r in rows if tuple(r[k] for k in keys) == key]
            made += processors[key][1].handleInputRows(key, own, None)
        for key, (handle, processor) in processors.items():
            for at in [t for t in handle.timers if t < watermark]:
                made += processor.handleExpiredTimer(key, None, None)
                handle.timers.remove(at)
        out.append(sorted(tuple(r.asDict().items()) for r in made))
    return out


def as_group(run, batches):
    state, out = Held(), []
    for state.watermark, rows in batches:
        state.hasTimedOut, made = False, []
        if rows:
            # Two frames, as Spark hands over a group that fills several batches.
            frames = [pd.DataFrame([r.asDict() for r in part]) for part in (rows[::2], rows[1::2]) if part]
            made += run((0,), frames, state)
        if state.exists and state.timeout < state.watermark:
            state.hasTimedOut = True
            made += run((0,), [], state)
        out.append(sorted(tuple(r.items()) for f in made for r in f.to_dict("records")))
    return out


@pytest.mark.parametrize("kind", [Segments, Fragments])
@pytest.mark.parametrize("seed", range(5))
def test_a_group_gives_what_its_keys_give(kind, seed):
    """Micro-batches of a few flows each, out of order, with pauses and holes."""
    rng, keys = random.Random(seed), FLOW if kind is Segments else FRAGMENT_KEY
    batches, ms = [], 1_000_000
    for n in range(12):
        rows = []
        for i in range(rng.randrange(0, 30)):
            key = dict(zip(keys, ("", 4, b"a", bytes([rng.randrange(4)]), 1000 + rng.randrange(2), 53)))
            own = {"seq": n * 100 + i, "ts_ns": (ms + rng.randrange(6000)) * 1_000_000}
            if kind is Segments:
                text = b"\0\x03abc" * rng.randrange(3)
                own |= {"tcp_seq": (2**32 - 20 + 5 * rng.randrange(12)) % 2**32, "tcp_flags": rng.choice([2, 16, 16, 16]), "payload": text}
            else:
                piece = rng.randrange(3)
                own |= {"frag_offset": piece, "more_fragments": piece < 2, "protocol_no": 17, "payload": bytes([n]) * 8}
            rows.append(Row(**key, **own))
        rng.shuffle(rows)
        batches.append((max(0, ms - 4000), rows))
        ms += rng.choice([2000, 6000, 25_000])
    batches.append((ms + 100_000, []))
    if kind is Segments:
        fields, steps = ["tcp_seq", "tcp_flags", "payload"], (reassembly.tcp_flow, reassembly.flush_flow)
    else:
        fields, steps = ["frag_offset", "more_fragments", "protocol_no", "payload"], (reassembly.fragment_train, reassembly.drop_train)
    run = reassembly.grouped(keys, ["seq", "ts_ns", *fields], list(kind.fields), *steps, GC_MS)
    wanted = per_key(kind, keys, batches)
    assert sum(map(len, wanted)) > 10
    assert as_group(run, batches) == wanted


def test_missing_numbers_are_one_key():
    """A cut fragment header leaves no identification: its trains are still told apart by the rest of the key."""
    run = reassembly.grouped(
        FRAGMENT_KEY, ["seq", "ts_ns", "frag_offset", "more_fragments", "protocol_no", "payload"],
        list(Fragments.fields), reassembly.fragment_train, reassembly.drop_train, GC_MS,
    )
    key = {"file": "", "ip_version": 6, "src_ip": b"a", "dst_ip": b"b", "key_protocol": -1}
    rows = [
        key | {"ip_id": i, "seq": n, "ts_ns": 10**9, "frag_offset": o, "more_fragments": o < 1, "protocol_no": 17, "payload": b"x" * 8}
        for n, (i, o) in enumerate([(None, 0), (7, 0), (None, 1)])
    ]
    state = Held()
    (made,) = run((0,), [pd.DataFrame(rows)], state)
    assert made.to_dict("records") == [key | {"ip_id": None, "seq": 2, "ts_ns": 10**9, "protocol_no": 17, "payload": b"x" * 16}]
