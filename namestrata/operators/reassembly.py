"""IP fragments to datagrams, TCP segments to DNS messages."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from namestrata.operators.carry import carry
from namestrata.operators.ordering import RANGE, chunk_numbers, sessions
from namestrata.session import cut_lineage

# Limits of a fragment train.
MAX_OFFSET = 8191
MAX_SIZE = 65535
MAX_FRAGMENTS = 8191

GC_SECONDS = 10
#: A chunk spans this many capture records, so it holds no more rows than that.
FRAGMENT_CHUNK_RECORDS = 200_000
TCP_CHUNK_BYTES = 4 << 20
#: Keys of up to so many rows and bytes are held by one task.
LIGHT_ROWS, LIGHT_BYTES = 50_000, 16 << 20
FIN, SYN, RST = 1, 2, 4

FRAGMENT_KEY = ["file", "ip_version", "src_ip", "dst_ip", "ip_id", "key_protocol"]


def sane_fragments(datagrams: DataFrame) -> DataFrame:
    """Fragments inside the size limits. IPv6 trains are not told apart by protocol."""
    fits = (F.col("frag_offset") <= MAX_OFFSET) & (
        F.col("frag_offset") * 8 + F.octet_length("payload") <= MAX_SIZE
    )
    key = F.when(F.col("ip_version") == 4, F.col("protocol_no")).otherwise(-1)
    return datagrams.filter("is_fragment").filter(fits).withColumn("key_protocol", key)


class FragmentTrain:
    """Fragments of one datagram seen so far; equal offsets are ignored.

    ``add`` returns the datagram's bytes when the train is complete, after which the train
    is empty again.
    """

    def __init__(self, held: dict[int, bytes] | None = None, final: bool = False):
        self.held = held or {}
        self.final = final

    def add(self, offset: int, more: bool, payload: bytes) -> bytes | None:
        if offset in self.held:
            return None
        self.held[offset] = payload
        self.final = self.final or not more
        if not self.final:
            return self._over_limit()
        end = max(8 * o + len(p) for o, p in self.held.items())
        if end != sum(len(p) for p in self.held.values()):
            return self._over_limit()
        data, at = [], 0
        for position in sorted(self.held):
            if 8 * position != at:
                # Overlap made the sums agree by accident: nothing comes out.
                return self._over_limit()
            data.append(self.held[position])
            at += len(self.held[position])
        self.held, self.final = {}, False
        return b"".join(data)

    def _over_limit(self) -> None:
        if len(self.held) + 1 > MAX_FRAGMENTS:
            self.held, self.final = {}, False


def _fragment_step(chunk: int, rows: list[tuple], state: bytes | None):
    held, final = pickle.loads(state) if state else ((), False)
    train = FragmentTrain(dict(held), final)
    out = []
    for seq, ts_ns, offset, more, payload, protocol in rows:
        data = train.add(offset, more, payload)
        if data is not None:
            out.append((seq, ts_ns, protocol, data))
    # The state after a complete train is the empty one every chunk is guessed to start with.
    ended = pickle.dumps((sorted(train.held.items()), train.final)) if train.held else b""
    return out, state or b"", ended


def reassemble_fragments(
    datagrams: DataFrame, gc_seconds: int = GC_SECONDS, several_chunks: bool | None = None,
    light_rows: int = LIGHT_ROWS, stored: bool = False,
) -> DataFrame:
    """Complete datagrams from IPv4 and IPv6 fragments.

    A train is keyed by addresses and identification (and protocol for IPv4) and forgotten
    after ``gc_seconds`` without a fragment. Keys of up to ``light_rows`` fragments are walked in
    one pass after one exchange. Only keys with more, which are reused all the time, are cut into
    sessions at such pauses and, inside a long session, into chunks of capture records that
    pass their unfinished train on. Datagrams that lie in a table (``stored``) are not stored again.
    """
    rows = sane_fragments(datagrams).select(
        *_key_columns(FRAGMENT_KEY), "seq", "ts_ns", "frag_offset", "more_fragments", "protocol_no",
        "payload", F.unix_micros("ts").alias("us"),
    )
    # Fragments are a small share of the packets but are read again below.
    rows = rows if stored else cut_lineage(rows, "fragments")
    done = _by_weight(
        rows, FRAGMENT_KEY, F.count(F.lit(1)) > light_rows,
        lambda light: _walk(light, FRAGMENT_KEY, FRAGMENT_FIELDS, _fragment_rows, "ts_ns BIGINT, protocol_no INT", gc_seconds),
        lambda heavy: _heavy_fragments(heavy, gc_seconds, several_chunks),
    )
    return done.select(
        "file", "seq", _stamp("ts_ns").alias("ts"), "ts_ns", "ip_version", "src_ip", "dst_ip",
        "protocol_no", "payload",
    )


def _heavy_fragments(rows: DataFrame, gc_seconds: int, several_chunks: bool | None) -> DataFrame:
    rows = sessions(rows, tuple(FRAGMENT_KEY), "us", gc_seconds * 1_000_000)
    rows = cut_lineage(rows, "fragment-sessions")
    key = [*FRAGMENT_KEY, "session"]
    rows = rows.withColumn("part", F.expr(f"seq div {FRAGMENT_CHUNK_RECORDS}"))
    return carry(
        chunk_numbers(rows, key, "part"), key, "chunk", ["seq"],
        ["seq", "ts_ns", "frag_offset", "more_fragments", "payload", "protocol_no"],
        _fragment_step, "seq BIGINT, ts_ns BIGINT, protocol_no INT, payload BINARY",
        several_chunks,
    )


def _by_weight(rows: DataFrame, key: list[str], heavy, walk, cut) -> DataFrame:
    """``walk`` over the keys that one task can hold, ``cut`` over those that the condition calls
    heavy; without such keys there is one pass only. Sizes come from narrow columns."""
    large = rows.groupBy(*key).agg(heavy.alias("__heavy")).filter("__heavy").select(*key)
    large = cut_lineage(large, "heavy-keys")
    if large.isEmpty():
        return walk(rows)
    light = walk(rows.join(large, key, "left_anti"))
    return light.unionByName(cut(rows.join(large, key, "left_semi")), allowMissingColumns=True)


def _walk(rows: DataFrame, key: list[str], fields: list[str], step, out: str, gc_seconds: int) -> DataFrame:
    """Every key's rows in one task's memory, one key after the other, as tuples of ``fields`` through
    ``step``."""
    names = [*key, *fields]
    keys = len(key)
    added = T.DataType.fromDDL(f"struct<seq: bigint, {_struct(out)}, payload: binary>").fields
    schema = T.StructType([*[rows.schema[k] for k in key], *added])
    arrow, gap = to_arrow_schema(schema), gc_seconds * 1_000_000

    def stream(batches):
        for batch in batches:
            columns = [column_values(batch.column(c)) for c in names]
            yield from zip(*columns)

    def job(batches):
        made: list[tuple] = []
        for own, group in groupby(stream(batches), key=itemgetter(*range(keys))):
            made += [(*own, *r) for r in step([r[keys:] for r in group], gap)]
            if len(made) >= 4096:
                yield _arrow_batch(made, arrow)
                made = []
        yield _arrow_batch(made, arrow)

    return rows.select(*names).repartition(*key).sortWithinPartitions(*key).mapInArrow(job, schema)


def column_values(column: pa.Array) -> list:
    """``to_pylist`` at a tenth of its cost a value, for numbers, flags, texts and bytes without NULLs."""
    kind = column.type
    if column.null_count or not len(column):
        return column.to_pylist()
    if pa.types.is_integer(kind) or pa.types.is_boolean(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_binary(kind):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
        data = column.buffers()[2]
        data = b"" if data is None else data.slice(ends[0], ends[-1] - ends[0]).to_pybytes()
        first = ends[0]
        return [data[a - first : b - first] for a, b in zip(ends, ends[1:])]
    if pa.types.is_string(kind):
        coded = column.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        return [texts[i] for i in coded.indices.to_numpy().tolist()]
    return column.to_pylist()


def _struct(ddl: str) -> str:
    return ", ".join(": ".join(f.split()) for f in ddl.split(", "))


def _arrow_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)


SEQ, US = 0, 1


def _runs(rows: list[tuple], gap: int, starts: int | None = None) -> Iterator[list[tuple]]:
    """Sessions of one key, as :func:`sessions` numbers them: after a pause, and at each row that
    has ``starts`` set. Rows begin with ``seq`` and ``us``."""
    if len(rows) == 1:
        yield rows
        return
    rows.sort(key=lambda r: (r[1] // gap, r[0] // RANGE, r[1], r[0]))
    run: list[tuple] = []
    last = part = None
    for r in rows:
        us = r[US]
        here = (us // gap, r[SEQ] // RANGE)
        idle = part is not None and here != part and us - last > gap
        last, part = us, here
        if run and (idle or (starts is not None and r[starts])):
            yield run
            run = []
        run.append(r)
    yield run


FRAGMENT_FIELDS = ["seq", "us", "ts_ns", "frag_offset", "more_fragments", "payload", "protocol_no"]


def _fragment_rows(rows: list[tuple], gap: int) -> list[tuple]:
    out = []
    for run in _runs(rows, gap):
        train = FragmentTrain()
        for seq, _, ts_ns, offset, more, payload, protocol in sorted(run, key=itemgetter(SEQ)):
            data = train.add(offset, more, payload)
            if data is not None:
                out.append((seq, ts_ns, protocol, data))
    return out


def _key_columns(names: list[str]) -> list:
    """Key columns without NULLs; only the file may be unknown."""
    return [F.coalesce(F.col(n), F.lit("")).alias(n) if n == "file" else F.col(n) for n in names]


def _stamp(ns: str):
    return F.timestamp_micros(F.expr(f"{ns} div 1000"))


# --- TCP -------------------------------------------------------------------------------------

FLOW = ["file", "ip_version", "src_ip", "dst_ip", "src_port", "dst_port"]
STREAM = [*FLOW, "session"]


def tcp_segments(segments: DataFrame) -> DataFrame:
    """What reassembly needs of each segment, stored: a small share of the packets, read again below."""
    rows = segments.select(
        *_key_columns(FLOW), "seq", "ts_ns", "tcp_seq", "payload", F.unix_micros("ts").alias("us"),
        (F.col("tcp_flags").bitwiseAND(SYN) != 0).alias("syn"), F.octet_length("payload").alias("size"),
    )
    return cut_lineage(rows, "segments")


def tcp_streams(rows: DataFrame, gc_seconds: int = GC_SECONDS) -> DataFrame:
    """Place every segment of :func:`tcp_segments` in its stream: adds ``session``, ``stream_ns`` and
    ``offset``.

    One direction of a flow is a stream until it pauses for ``gc_seconds`` or a new SYN.
    Sequence numbers wrap at 32 bits. Each time slot keeps the number of its first segment;
    the signed steps between slots add up to 64-bit positions, and a segment's place is its
    signed distance from its slot's first one.
    """
    rows = sessions(rows, tuple(FLOW), "us", gc_seconds * 1_000_000, starts="syn")
    # A SYN takes one number, so the data begins one later.
    rows = rows.withColumn("number", F.col("tcp_seq") + F.when(F.col("syn"), 1).otherwise(0))
    rows = rows.withColumn("slot", F.expr(f"us div {gc_seconds * 1_000_000}"))
    key = [*STREAM, "slot"]
    slots = rows.groupBy(*key).agg(
        F.min(F.struct("us", "seq", "ts_ns", "number")).alias("begin")
    )
    slots = slots.withColumn("first", F.col("begin.number"))
    line = Window.partitionBy(*STREAM).orderBy("slot")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = _signed32(F.col("first") - F.lag("first").over(line))
    slots = slots.withColumn("moved", F.coalesce(moved, F.lit(0))).select(
        *key, "first", F.sum("moved").over(upto).alias("base"), F.first("begin").over(upto).alias("begin")
    )
    place = F.col("base") + _signed32(F.col("number") - F.col("first"))
    return rows.join(slots, key).select(
        *STREAM, "payload", place.alias("offset"), F.col("begin.ts_ns").alias("stream_ns"),
        F.col("begin.seq").alias("stream_seq"),
    )


def _signed32(distance):
    turn = F.lit(1 << 32)
    return F.pmod(distance + F.lit(1 << 31), turn) - F.lit(1 << 31)


UNKNOWN = b"?"


def _framing_step(chunk: int, rows: list[tuple], state: bytes | None):
    """Cut a run of segments into length-prefixed messages.

    The state is the position up to which bytes were taken and the unfinished message; it is
    empty where a message ends and the next chunk begins. A later chunk without a state
    starts at the first segment that looks like the beginning of a message.
    """
    used = b"" if state is None else state
    position, tail = pickle.loads(state) if state else (None, b"")
    following = rows[0][2]
    if state is None and chunk > 0:
        entry = _first_message([payload for _, payload, _ in rows])
        used = b"" if entry == 0 else UNKNOWN
        rows = rows[entry:]
    messages = []
    for offset, payload, _ in rows:
        if position is not None and offset < position:
            payload, offset = payload[position - offset :], position
        if not payload:
            continue
        position = offset + len(payload)
        tail += payload
        at = 0
        while len(tail) - at >= 2:
            size = int.from_bytes(tail[at : at + 2], "big") + 2
            if len(tail) - at < size:
                break
            messages.append((offset, len(messages), tail[at + 2 : at + size]))
            at += size
        tail = tail[at:]
    clean = not tail and (position is None or following is None or position <= following)
    return messages, used, b"" if clean else pickle.dumps((position, tail))


def _first_message(pieces: list[bytes], enough: int = 8) -> int:
    """Index of the first segment from which plausible messages follow one another."""
    for start in range(len(pieces)):
        data, at, seen = b"".join(pieces[start : start + 4 * enough]), 0, 0
        while seen < enough and len(data) - at >= 14:
            size = int.from_bytes(data[at : at + 2], "big")
            questions = int.from_bytes(data[at + 6 : at + 8], "big")
            if size < 12 or questions > 4:
                break
            at, seen = at + size + 2, seen + 1
        else:
            return start
    return 0


SEGMENT_FIELDS = ["seq", "us", "ts_ns", "tcp_seq", "syn", "payload"]


def _segment_rows(rows: list[tuple], gap: int) -> list[tuple]:
    """Messages of one flow that fits into memory, placed as in :func:`tcp_streams`."""
    out = []
    for run in _runs(rows, gap, starts=SEGMENT_FIELDS.index("syn")):
        base = first = begin = slot = None
        pieces: dict[int, bytes] = {}
        # A slot's rows lie together, so the order within slots of the time is that of the time.
        run.sort(key=itemgetter(US, SEQ))
        for seq, us, ts_ns, tcp_seq, syn, payload in run:
            number = tcp_seq + syn
            if slot != us // gap:
                slot = us // gap
                base = 0 if base is None else base + _signed(number - first)
                first = number
                begin = begin or (seq, ts_ns)
            offset = base + _signed(number - first)
            if payload and len(payload) > len(pieces.get(offset, b"")):
                pieces[offset] = payload
        if pieces:
            messages, _, _ = _framing_step(0, [(o, pieces[o], None) for o in sorted(pieces)], None)
            out += [(*begin, *m) for m in messages]
    return out


def _signed(distance: int) -> int:
    return (distance + (1 << 31)) % (1 << 32) - (1 << 31)


def tcp_messages(
    segments: DataFrame, gc_seconds: int = GC_SECONDS, several_chunks: bool | None = None,
    light_rows: int = LIGHT_ROWS, light_bytes: int = LIGHT_BYTES,
) -> DataFrame:
    """DNS messages carried by TCP segments, one row per message.

    Segments are put in stream order, repeated bytes are dropped and holes are closed up. Flows of
    up to ``light_rows`` segments and ``light_bytes`` are walked in one pass after one exchange.
    Of larger ones, copies of a segment collapse in a partial aggregation before anything is
    grouped, and a stream is worked off in chunks of a few megabytes. The time of a message is the
    time its stream began.
    """
    rows = tcp_segments(segments)
    found = _by_weight(
        rows, FLOW, (F.count(F.lit(1)) > light_rows) | (F.sum("size") > light_bytes),
        lambda light: _walk(light, FLOW, SEGMENT_FIELDS, _segment_rows, "ts_ns BIGINT, offset BIGINT, part INT", gc_seconds),
        lambda heavy: _heavy_messages(heavy, gc_seconds, several_chunks),
    )
    return found.select(
        "file", "seq", _stamp("ts_ns").alias("ts"), "ts_ns", "ip_version", "src_ip", "dst_ip", "src_port",
        "dst_port", "offset", "part", "payload",
    )


def _heavy_messages(rows: DataFrame, gc_seconds: int, several_chunks: bool | None) -> DataFrame:
    placed = tcp_streams(rows, gc_seconds).filter(F.octet_length("payload") > 0)
    begins = [*STREAM, "stream_ns", "stream_seq"]
    rows = placed.groupBy(*begins, "offset").agg(
        F.max_by("payload", F.octet_length("payload")).alias("payload")
    )
    # Placed once; numbering chunks and looking for long streams read it again.
    rows = cut_lineage(rows, "placed").withColumn("range", F.expr(f"offset div {TCP_CHUNK_BYTES}"))
    found = carry(
        chunk_numbers(rows, begins, "range", first="offset"), begins, "chunk", ["offset"],
        ["offset", "payload", "next_first"], _framing_step,
        "offset BIGINT, part INT, payload BINARY", several_chunks,
    )
    return found.withColumnsRenamed({"stream_seq": "seq", "stream_ns": "ts_ns"})
