"""Stream helpers that need more than one micro-batch or a failure."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from namestrata.operators.reassembly import FLOW, FRAGMENT_KEY
from namestrata.operators.rollups import rollup
from namestrata.plans import traffic
from namestrata.sources.domain_lists import domain_list_from
from namestrata.streaming import jobs
from namestrata.streaming.reassembly import Fragments, Segments, TcpStream
from tests.conftest import SF


def test_list_reload_keeps_the_last_good_list(spark):
    now, lists = [0.0], [["a.,fqdn"], None, ["b.,fqdn"]]

    def load():
        lines = lists.pop(0)
        if lines is None:
            raise OSError("gone")
        return domain_list_from(spark, lines)

    reloaded = jobs.ReloadedList(load, 60, clock=lambda: now[0])
    seen = []
    for now[0] in (0, 30, 61, 130):
        seen.append(reloaded.get().first().pattern)
    assert seen == ["a.", "a.", "a.", "b."]


def test_rollup_over_blocks_equals_batch_and_replays_once(spark, tmp_path):
    log = traffic.dns_log(spark, SF)
    names = ["general", "domain_count"]
    for block in (0, 1, 2, 1):
        jobs.append_partials(log.filter(F.col("seq") % 3 == block), block, str(tmp_path), names)
    for name in names:
        merged = jobs.read_rollup(spark, str(tmp_path), name, "day")
        batch = rollup(log, name, "day").select(*merged.columns)
        assert merged.exceptAll(batch).count() == 0 and batch.exceptAll(merged).count() == 0


def test_outputs_must_be_on(spark):
    with pytest.raises(ValueError):
        jobs.fan_out(spark.range(1), [("parquet", 0, {}), ("parquet", 5, {})], "unused")


def framed(text):
    return len(text).to_bytes(2, "big") + text


def test_tcp_stream_flushes_over_a_hole():
    stream = TcpStream()
    first, second = framed(b"one"), framed(b"two")
    assert stream.add(0, 0, 99, True, b"") == []
    assert [m[2] for m in stream.add(1, 1, 100, False, first)] == [b"one"]
    assert stream.add(2, 2, 200, False, second) == []
    assert [m[2] for m in stream.flush()] == [b"two"]


def test_tcp_stream_without_syn_waits_for_the_flush():
    stream = TcpStream()
    data = framed(b"abcdef")
    assert stream.add(5, 7, 4, False, data[4:]) == []
    assert stream.add(6, 8, 0, False, data[:4]) == []
    assert stream.flush() == [(5, 7, b"abcdef")]


class Handle:
    """A state handle and its one value in memory; ``calls`` are the round trips a real one would make."""

    def __init__(self):
        self.calls, self.held, self.timers = [], None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.calls.append("exists")
        return self.held is not None

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def clear(self):
        self.calls.append("clear")
        self.held = None

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("timer")
        self.timers.remove(at)


def test_a_key_costs_few_round_trips():
    """One to look, none more for a train that is complete, two to store a flow; timers follow it."""
    handle, fragments = Handle(), Fragments(FRAGMENT_KEY, 10_000)
    fragments.init(handle)
    key = ("", 4, b"a", b"b", 7, 17)
    whole = [
        Row(seq=n, ts_ns=1_000_000, frag_offset=n, more_fragments=n < 1, payload=b"x" * 8, protocol_no=17) for n in (0, 1)
    ]
    assert [r.payload for r in fragments.handleInputRows(key, whole, None)] == [b"x" * 16]
    assert handle.calls == ["get"] and not handle.timers
    list(fragments.handleInputRows(key, whole[:1], None))
    assert handle.timers == {10_001} and handle.calls[1:] == ["get", "update", "timer"]
    assert [r.payload for r in fragments.handleInputRows(key, whole[1:], None)] == [b"x" * 16]
    assert handle.held is None and not handle.timers

    handle, segments = Handle(), Segments(FLOW, 10_000)
    segments.init(handle)
    key = ("", 4, b"a", b"b", 1024, 53)
    for n, at in enumerate((1, 1, 5)):
        row = Row(seq=n, ts_ns=at * 1_000_000, tcp_seq=9 + n, tcp_flags=16, payload=b"x")
        list(segments.handleInputRows(key, [row], None))
        assert handle.timers == {10_000 + at}
    assert len(handle.calls) == 3 + 2 + 4
