"""Order-dependent operators against step-by-step models."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namestrata.operators import ordering, reassembly, sampling
from namestrata.operators.ordering import arrival_number, sessions
from namestrata.operators.reassembly import FragmentTrain


def model(a, b, n, mode):
    """The counters as they run, one record at a time."""
    count, kept = 0, []
    for i in range(1, n + 1):
        if mode == "reference_packet":
            skip = False
            if a != b:
                count += 1
                if count % b > a:
                    if count > a * b:
                        count = 0
                    skip = True
            if not skip:
                kept.append(i)
        else:
            count += 1
            if count % b < a:
                if count > a * b:
                    count = 0
                kept.append(i)
    return kept


@pytest.mark.parametrize("mode", ["reference_packet", "reference_dnstap"])
def test_sampling_closed_form(spark, mode):
    pairs = [(a, b) for b in range(1, 9) for a in range(b + 1) if (mode, a, b) != ("reference_dnstap", 1, 1)]
    n = F.col("id") + 1
    columns = [sampling.sample_condition(n, a, b, mode).alias(f"k{a}_{b}") for a, b in pairs]
    rows = spark.range(300).select("id", *columns).orderBy("id").collect()
    for a, b in pairs:
        mine = [r["id"] + 1 for r in rows if r[f"k{a}_{b}"]]
        expected = list(range(1, 301)) if a == b else model(a, b, 300, mode)
        assert mine == expected, (a, b)


@pytest.mark.parametrize("text", ["1-100", "100:1", "a:b", "1:2:3"])
def test_bad_ratios(text):
    with pytest.raises(ValueError):
        sampling.parse_ratio(text)


def test_arrival_number_over_ranges(spark):
    rng = random.Random(3)
    rows = [(g, v) for g in ("a", "b", None) for v in rng.sample(range(5000), 200)]
    df = spark.createDataFrame(rows, "g string, seq bigint")
    out = arrival_number(df, "seq", ("g",), width=37).collect()
    for g in ("a", "b", None):
        mine = sorted((r.seq, r.n) for r in out if r.g == g)
        assert [n for _, n in mine] == list(range(1, 201))


def test_sessions_split_at_pauses_and_starts(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE", 5)
    rng = random.Random(5)
    times, t = [], 0
    for _ in range(300):
        t += rng.choice([1, 3, 9, 10, 11, 25])
        times.append(t)
    rows = [("k", i, t, rng.random() < 0.1) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, seq bigint, us bigint, start boolean")
    mine = {r.seq: r.session for r in sessions(df, ("k",), "us", 10, "start").collect()}
    groups, last = [], None
    for _, seq, us, start in rows:
        if last is None or us - last > 10 or start:
            groups.append([])
        groups[-1].append(seq)
        last = us
    assert [{mine[s] for s in g} for g in groups] == [{mine[g[0]]} for g in groups]
    assert len({mine[g[0]] for g in groups}) == len(groups)


def test_copies_first_seen_wins(spark):
    hashes = [1, 2, 3, 1, 2, 4, 5]
    rows = [(i, 1_700_000_000, bytes([h])) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "seq bigint, s bigint, data binary")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    for exact in (False, True):
        kept = sampling.drop_copies(df, 60, exact_hash=exact)
        assert sorted(r.seq for r in kept.collect()) == [0, 1, 2, 5, 6]


def test_copy_of_rejected_packet_is_hidden(spark):
    rows = [(i, 1_700_000_000, d) for i, d in enumerate([b"a", b"b", b"c", b"x", b"x", b"x", b"x"])]
    df = spark.createDataFrame(rows, "seq bigint, s bigint, data binary").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    kept = sampling.sample_then_drop_copies(df, "1:5", number="seq", seconds=60)
    sampled = model(1, 5, 7, "reference_packet")
    first = {b"a": 1, b"b": 2, b"c": 3, b"x": 4}.values()
    assert sorted(r.seq + 1 for r in kept.collect()) == sorted(set(sampled) & set(first))


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def test_fnv(spark):
    rng = random.Random(1)
    values = [b"", b"a", *[rng.randbytes(rng.randrange(200)) for _ in range(50)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary")
    out = df.select("i", sampling.fnv1a64("v").alias("h")).collect()
    assert all(r.h == fnv(values[r.i]) for r in out)


def test_packet_limit(spark):
    df = spark.range(150).select(F.col("id").alias("seq"), F.lit(1).alias("flush"))
    assert sampling.limit_per_flush(df, 0, "flush").count() == 150
    assert sampling.limit_per_flush(df, 100, "flush").count() == 100


def fragments(datagrams, rng, ident=7):
    """(seq, ts_ns, offset, more, payload) of datagrams that all reuse one key."""
    rows, seq = [], 0
    for data in datagrams:
        cuts = [data[:16], data[16:40], data[40:]]
        order = [0, 1, 2]
        rng.shuffle(order)
        for i in order:
            rows.append((seq, seq * 1_000_000, (0, 2, 5)[i], i < 2, cuts[i]))
            seq += 1
            if rng.random() < 0.1:
                rows.append((seq, seq * 1_000_000, (0, 2, 5)[i], i < 2, cuts[i]))
                seq += 1
    return rows


@pytest.mark.parametrize("light", [0, 100_000])
@pytest.mark.parametrize("lost", [0.0, 0.05])
def test_hot_fragment_key_in_chunks(spark, monkeypatch, lost, light):
    """One key reused by all datagrams, cut into tiny chunks or held whole, equals the one-by-one walk."""
    monkeypatch.setattr(reassembly, "FRAGMENT_CHUNK_RECORDS", 7)
    rng = random.Random(11)
    rows = fragments([rng.randbytes(60) for _ in range(60)], rng)
    rows = [r for r in rows if rng.random() >= lost]
    train, expected = FragmentTrain(), []
    for seq, _, offset, more, payload in rows:
        data = train.add(offset, more, payload)
        if data is not None:
            expected.append((seq, data))
    df = spark.createDataFrame(
        rows, "seq bigint, ts_ns bigint, frag_offset int, more_fragments boolean, payload binary"
    ).select(
        F.lit("f").alias("file"), "seq", F.timestamp_micros(F.expr("ts_ns div 1000")).alias("ts"), "ts_ns",
        F.lit(4).alias("ip_version"), F.lit(b"\x01\x02\x03\x04").alias("src_ip"),
        F.lit(b"\x05\x06\x07\x08").alias("dst_ip"), F.lit(7).cast("bigint").alias("ip_id"),
        F.lit(17).alias("protocol_no"), "frag_offset", "more_fragments", F.lit(True).alias("is_fragment"),
        "payload",
    )
    mine = reassembly.reassemble_fragments(df, light_rows=light).select("seq", "payload").collect()
    assert sorted((r.seq, bytes(r.payload)) for r in mine) == sorted(expected)


@pytest.mark.parametrize("light", [0, 100_000])
def test_train_expires_after_a_pause(spark, light):
    rows = [(0, 0, 0, True, b"a" * 16), (1, 60_000_000_000, 2, False, b"b" * 8)]
    base = spark.createDataFrame(
        rows, "seq bigint, ts_ns bigint, frag_offset int, more_fragments boolean, payload binary"
    ).select(
        "*", F.lit("f").alias("file"), F.timestamp_micros(F.expr("ts_ns div 1000")).alias("ts"),
        F.lit(6).alias("ip_version"), F.lit(bytes(16)).alias("src_ip"), F.lit(bytes(16)).alias("dst_ip"),
        F.lit(7).cast("bigint").alias("ip_id"), F.lit(17).alias("protocol_no"),
        F.lit(True).alias("is_fragment"),
    )
    assert reassembly.reassemble_fragments(base, gc_seconds=10, light_rows=light).count() == 0
    assert reassembly.reassemble_fragments(base, gc_seconds=120, light_rows=light).count() == 1


@pytest.mark.parametrize("light", [0, 100_000])
@pytest.mark.parametrize("start", [100, (1 << 32) - 500])
def test_long_tcp_stream_in_chunks(spark, monkeypatch, start, light):
    """A stream over many chunks, shuffled, repeated and wrapping, gives all its messages."""
    monkeypatch.setattr(reassembly, "TCP_CHUNK_BYTES", 256)
    rng = random.Random(2)
    messages = [bytes([0, i, 0, 0, 0, 1] + [0] * 6) + rng.randbytes(rng.randrange(60)) for i in range(120)]
    body = b"".join(len(m).to_bytes(2, "big") + m for m in messages)
    cuts, at = [], 0
    while at < len(body):
        size = rng.randrange(1, 90)
        cuts.append((at, body[at : at + size]))
        at += size
    arrivals = []
    for i in range(0, len(cuts), 4):
        part = cuts[i : i + 4] + ([cuts[i]] if rng.random() < 0.3 else [])
        rng.shuffle(part)
        arrivals += part
    rows = [(0, start, 2, b"")]
    rows += [(i + 1, (start + 1 + at) % (1 << 32), 16, data) for i, (at, data) in enumerate(arrivals)]
    df = spark.createDataFrame(rows, "seq bigint, tcp_seq bigint, tcp_flags int, payload binary").select(
        "*", F.lit("f").alias("file"), F.lit(4).alias("ip_version"), F.lit(b"abcd").alias("src_ip"),
        F.lit(b"efgh").alias("dst_ip"), F.lit(999).alias("src_port"), F.lit(53).alias("dst_port"),
        (F.col("seq") * 1_000_000).alias("ts_ns"), F.timestamp_millis("seq").alias("ts"),
    )
    out = reassembly.tcp_messages(df, light_rows=light).orderBy("offset", "part").collect()
    assert sorted(bytes(r.payload) for r in out) == sorted(messages)
    assert {r.seq for r in out} == {0}


def test_both_lanes_agree_on_flows_of_all_kinds(spark):
    """Flows with SYNs, pauses, losses, copies and no beginning, in one pass and cut up."""
    rng = random.Random(5)
    rows, seq = [], 0
    for flow in range(40):
        number, us = rng.randrange(1 << 32), rng.randrange(10**9)
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.7:
                rows.append((seq, us, flow, number, 2, b""))
                number, seq = (number + 1) % (1 << 32), seq + 1
            for _ in range(rng.randrange(1, 12)):
                message = bytes([0, flow, 0, 0, 0, 1] + [0] * 6) + rng.randbytes(rng.randrange(30))
                data = len(message).to_bytes(2, "big") + message
                for piece in (data[:9], data[9:]):
                    for _ in range(rng.choice([0, 1, 1, 1, 1, 2])):
                        rows.append((seq, us, flow, number, 16, piece))
                        seq, us = seq + 1, us + rng.choice([1000, 1000, 4_000_000])
                    number = (number + len(piece)) % (1 << 32)
            us += rng.choice([1000, 30_000_000])
    df = spark.createDataFrame(rows, "seq bigint, us bigint, flow int, tcp_seq bigint, tcp_flags int, payload binary").select(
        "*", F.lit(None).cast("string").alias("file"), F.lit(4).alias("ip_version"), F.lit(b"abcd").alias("src_ip"),
        F.lit(b"efgh").alias("dst_ip"), (F.col("flow") + 1000).alias("src_port"), F.lit(53).alias("dst_port"),
        (F.col("us") * 1000).alias("ts_ns"), F.timestamp_micros("us").alias("ts"),
    )
    found = []
    for light in (0, 30, 100_000):
        out = reassembly.tcp_messages(df, light_rows=light).collect()
        found.append(sorted((r.src_port, r.seq, r.ts_ns, r.offset, r.part, bytes(r.payload)) for r in out))
    assert found[0] == found[1] == found[2] and len(found[0]) > 200


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12))
def test_train_never_returns_partial_data(order):
    pieces = {0: (0, True, b"a" * 8), 1: (1, True, b"b" * 8), 2: (2, False, b"c" * 3)}
    train, seen = FragmentTrain(), set()
    for i in order:
        data = train.add(*pieces[i])
        seen.add(i)
        if data is not None:
            assert seen == {0, 1, 2} and data == b"a" * 8 + b"b" * 8 + b"c" * 3
            seen = set()
