"""Capture files (pcap, pcapng) to packet rows.

Two ways in. ``packets_from_contents`` takes files as ``binaryFile`` rows, right for many
small captures. ``read_captures`` takes paths: files are split by bytes, a light first job
finds the records of every split, a second one reads them, so one huge capture spreads over
the cluster like any other splittable file. Splits start at once from a guessed place; the one
before tells whether it was right. What a pcapng split needs from earlier ones, the interfaces
declared there, is put together from what all splits report, in one step for any number of them.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namestrata.operators.carry import carry
from namestrata.schemas import PACKETS
from namestrata.session import cut_lineage

# File magics, block types and option codes of the two formats.
PCAP_MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\xc3\xd4": (">", 1000),
    b"\x4d\x3c\xb2\xa1": ("<", 1),
    b"\xa1\xb2\x3c\x4d": (">", 1),
}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
TIME_RESOLUTION = 9
#: Types of blocks by which a split finds its place: the registered ones.
BLOCKS = {SECTION, *range(1, 13), 0x204, 0x216, 0xBAD, 0x40000BAD}

SPLIT_BYTES = 128 << 20
BATCH_BYTES = 16 << 20
MAX_RECORD = 1 << 18


def sniff(content) -> F.Column:
    """``pcapng`` or ``pcap`` by the first four bytes of a BINARY column."""
    return F.when(F.substring(content, 1, 4) == F.lit(PCAPNG_MAGIC), "pcapng").otherwise("pcap")


@dataclass
class PcapLayout:
    """Record layout of a classic pcap file."""

    order: str
    tick_ns: int
    link_type: int

    @classmethod
    def parse(cls, head: bytes) -> PcapLayout:
        if len(head) < 24 or head[:4] not in PCAP_MAGICS:
            raise ValueError("not a capture file")
        order, tick = PCAP_MAGICS[head[:4]]
        return cls(order, tick, struct.unpack_from(order + "I", head, 20)[0] & 0x0FFFFFFF)

    def header(self, data, at: int) -> tuple[int, int, int, int]:
        """(seconds, ticks, captured length, original length) of the record at ``at``."""
        return struct.unpack_from(self.order + "IIII", data, at)

    def plausible(self, data, at: int, records: int = 6) -> bool:
        """Whether ``records`` sane records follow one another from ``at``."""
        previous = None
        for _ in range(records):
            if at + 16 > len(data):
                return True
            seconds, ticks, size, original = self.header(data, at)
            sane = 0 < size <= MAX_RECORD and size <= original <= MAX_RECORD
            if not sane or ticks * self.tick_ns >= 1_000_000_000:
                return False
            if previous is not None and abs(seconds - previous) > 86_400:
                return False
            previous, at = seconds, at + 16 + size
        return True


@dataclass
class PcapngState:
    """Byte order and interfaces (link type, nanoseconds per tick) seen so far."""

    order: str = "<"
    interfaces: list = field(default_factory=list)

    def block(self, data: bytes):
        """Feed one whole block; returns (ts_ns, caplen, wirelen, link, start) of a packet."""
        kind = struct.unpack_from(self.order + "I", data, 0)[0]
        if data[:4] == PCAPNG_MAGIC:
            self.order = "<" if data[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            self.interfaces = []
        elif kind == INTERFACE:
            link = struct.unpack_from(self.order + "H", data, 8)[0]
            self.interfaces.append((link, self._resolution(data)))
        elif kind == ENHANCED:
            number, high, low, size, original = struct.unpack_from(self.order + "IIIII", data, 8)
            if number < len(self.interfaces) and 28 + size <= len(data):
                link, per_second = self.interfaces[number]
                ticks = high << 32 | low
                return ticks * 1_000_000_000 // per_second, size, original, link, 28
        elif kind == SIMPLE and self.interfaces:
            original = struct.unpack_from(self.order + "I", data, 8)[0]
            return 0, min(original, len(data) - 16), original, self.interfaces[0][0], 12
        return None

    def packet_interface(self, data: bytes) -> int | None:
        """Number of the interface of a packet block, if it holds its whole packet; else None."""
        kind = struct.unpack_from(self.order + "I", data, 0)[0]
        if kind == ENHANCED:
            number, _, _, size = struct.unpack_from(self.order + "IIII", data, 8)
            return number if 28 + size <= len(data) else None
        return 0 if kind == SIMPLE else None

    def _resolution(self, data: bytes) -> int:
        at = 16
        while at + 4 <= len(data) - 4:
            code, size = struct.unpack_from(self.order + "HH", data, at)
            if code == 0:
                break
            if code == TIME_RESOLUTION and size:
                value = data[at + 4]
                return 2 ** (value & 0x7F) if value & 0x80 else 10**value
            at += 4 + (size + 3) // 4 * 4
        return 1_000_000


def block_size(order: str, head: bytes) -> int:
    """Length of the pcapng block that starts with these twelve bytes."""
    if head[:4] == PCAPNG_MAGIC:
        order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
    return struct.unpack_from(order + "I", head, 4)[0]


class _Rows:
    """Collects packets and hands out Arrow batches of bounded size.

    ``columns`` are the ones handed out, all by default; ``keep`` judges a packet by the dict of its
    numbers, before it takes up memory.
    """

    def __init__(self, file: str, columns: list[str] | None = None, keep=None):
        self.file, self.columns, self.keep, self.rows, self.bytes = file, columns, keep, [], 0
        self.payload = columns is None or "data" in columns

    def add(self, seq, ts_ns, caplen, wirelen, link, data):
        if self.keep and not self.keep({"seq": seq, "ts_ns": ts_ns, "caplen": caplen, "wirelen": wirelen, "link_type": link}):
            return
        self.rows.append((seq, ts_ns, caplen, wirelen, link, data if self.payload else None))
        self.bytes += caplen if self.payload else 64

    def full(self) -> bool:
        return self.bytes >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        seq, ts_ns, caplen, wirelen, link, data = zip(*self.rows) if self.rows else ([],) * 6
        stamps = pa.array([t // 1000 for t in ts_ns], pa.int64()).cast(pa.timestamp("us", tz="UTC"))
        arrays = [
            pa.array([self.file] * len(seq), pa.string()), pa.array(seq, pa.int64()), stamps,
            pa.array(ts_ns, pa.int64()), pa.array(caplen, pa.int32()),
            pa.array(wirelen, pa.int32()), pa.array(link, pa.int32()), pa.array(data, pa.binary()),
        ]
        names = ["file", "seq", "ts", "ts_ns", "caplen", "wirelen", "link_type", "data"]
        self.rows, self.bytes = [], 0
        batch = pa.RecordBatch.from_arrays(arrays, names=names)
        return batch.select(self.columns) if self.columns is not None else batch


class _Memory:
    """A file already in memory, with the few calls the readers need."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, size: int, at: int) -> bytes:
        return self.data[at : at + size]

    def size(self) -> int:
        return len(self.data)


class _Window:
    """Positioned reads through one large window, so record headers cost no round trip."""

    def __init__(self, source, width: int = 4 << 20):
        self.source, self.width, self.start, self.data = source, width, 0, b""

    def read_at(self, size: int, at: int) -> bytes:
        if not (self.start <= at and at + size <= self.start + len(self.data)):
            self.start, self.data = at, self.source.read_at(max(size, self.width), at)
        return self.data[at - self.start : at - self.start + size]

    def size(self) -> int:
        return self.source.size()


def arrow_uri(path: str) -> str:
    """``path`` with the scheme that Arrow knows its store by; Hadoop has two more names for S3."""
    scheme, mark, rest = path.partition("://")
    return f"s3://{rest}" if mark and scheme.lower() in ("s3a", "s3n") else path


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """(file system, name there) of a path or URI. Keys and region of S3 come from its usual environment."""
    uri = arrow_uri(path)
    return arrow_fs.FileSystem.from_uri(uri) if ":/" in uri else (arrow_fs.LocalFileSystem(), uri)


class _Remote:
    """A file on any file system Arrow can open."""

    def __init__(self, path: str):
        system, name = file_system(path)
        self.file = system.open_input_file(name)

    def read_at(self, size: int, at: int) -> bytes:
        left = self.file.size() - at
        return self.file.read_at(min(size, left), at) if left > 0 else b""

    def size(self) -> int:
        return self.file.size()


def _read_pcap(source, layout, rows, at, stop, seq) -> Iterator[pa.RecordBatch]:
    while at < stop:
        head = source.read_at(16, at)
        if len(head) < 16:
            break
        seconds, ticks, size, original = layout.header(head, 0)
        data = source.read_at(size, at + 16)
        if len(data) < size:
            break
        rows.add(seq, seconds * 1_000_000_000 + ticks * layout.tick_ns, size, original,
                 layout.link_type, data)
        seq, at = seq + 1, at + 16 + size
        if rows.full():
            yield rows.batch()
    yield rows.batch()


def _read_pcapng(source, state, rows, at, stop, seq) -> Iterator[pa.RecordBatch]:
    while at < stop:
        head = source.read_at(12, at)
        size = block_size(state.order, head) if len(head) == 12 else 0
        if size < 12:
            break
        block = source.read_at(size, at)
        if len(block) < size:
            break
        packet = state.block(block)
        if packet:
            ts_ns, caplen, wirelen, link, start = packet
            rows.add(seq, ts_ns, caplen, wirelen, link, block[start : start + caplen])
            seq += 1
        at += size
        if rows.full():
            yield rows.batch()
    yield rows.batch()


def _read_whole(source, file: str) -> Iterator[pa.RecordBatch]:
    head = source.read_at(24, 0)
    if head[:4] == PCAPNG_MAGIC:
        yield from _read_pcapng(source, PcapngState(), _Rows(file), 0, source.size(), 0)
    elif head[:4] in PCAP_MAGICS and len(head) == 24:
        yield from _read_pcap(source, PcapLayout.parse(head), _Rows(file), 24, source.size(), 0)
    # Anything else is no capture: it yields no packets and fails no task.


def packets_from_contents(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Packets of ``binaryFile`` rows; ``seq`` is the record number in its file."""

    def job(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                yield from _read_whole(_Memory(data.as_py() or b""), name.as_py())

    return files.select(path, content).mapInArrow(job, PACKETS)


# --- splittable reads ------------------------------------------------------------------------


def _pcap_split(chunk: int, rows: list[tuple], state: bytes | None):
    """Walk the record headers of one byte split; state is where its first record starts."""
    path, begin, stop = rows[0]
    source = _Window(_Remote(path))
    layout = PcapLayout.parse(source.read_at(24, 0))
    if state:
        at = struct.unpack(">q", state)[0]
    elif begin == 0:
        at = 24
    else:
        at = begin
        window = source.read_at(2 * MAX_RECORD + (1 << 16), begin)
        while at < stop and not layout.plausible(window, at - begin):
            at += 1
    used = b"" if begin == 0 else struct.pack(">q", at)
    first, count = at, 0
    while at < stop:
        head = source.read_at(16, at)
        if len(head) < 16:
            break
        at, count = at + 16 + layout.header(head, 0)[2], count + 1
    return [(chunk, stop, first, count, b"")], used, struct.pack(">q", at)


def _pcapng_start(data: bytes) -> tuple[int, str] | None:
    """First place in ``data`` that looks like the start of a block, and its byte order."""
    places = ((at, order) for at in range(0, len(data) - 11, 4) for order in "<>")
    return next((p for p in places if _blocks_follow(data, *p)), None)


def _blocks_follow(data: bytes, at: int, order: str, blocks: int = 4) -> bool:
    """Whether ``blocks`` whole blocks follow one another, or as many as the data holds."""
    for seen in range(blocks):
        if at + 12 > len(data):
            return seen > 0
        if data[at : at + 4] == PCAPNG_MAGIC:
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind not in BLOCKS or size < 12 or size % 4 or size > MAX_RECORD:
            return False
        if at + size > len(data):
            return True
        if struct.unpack_from(order + "I", data, at + size - 4)[0] != size:
            return False
        at += size
    return True


def _pcapng_split(chunk: int, rows: list[tuple], state: bytes | None):
    """Walk the blocks of one byte split; state is where its first block starts and the byte order.

    A split other than the first starts at a place that looks like a block in either byte order, and
    is run again only if the split before ended elsewhere. What interfaces hold
    there is not known yet, so it tells which ones it declares and how many packets each number has
    before and between them.
    """
    path, begin, stop = rows[0]
    source = _Window(_Remote(path))
    head = source.read_at(12, 0)
    order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
    if state:
        at, order = pickle.loads(state)
    elif begin == 0:
        at = 0
    else:
        found = _pcapng_start(source.read_at(stop - begin, begin))
        at, order = (begin + found[0], found[1]) if found else (stop, order)
    used = b"" if begin == 0 else pickle.dumps((at, order))
    first, start_order, reader = at, order, PcapngState(order)
    told: list = []
    while at < stop:
        head = source.read_at(12, at)
        size = block_size(reader.order, head) if len(head) == 12 else 0
        if size < 12:
            break
        block = source.read_at(size, at)
        kind = struct.unpack_from(reader.order + "I", block, 0)[0]
        if kind in (SECTION, INTERFACE):
            reader.block(block)
            told.append((SECTION, reader.order) if kind == SECTION else (INTERFACE, reader.interfaces[-1]))
        else:
            number = reader.packet_interface(block)
            if number is not None:
                if not told or told[-1][0] != ENHANCED:
                    told.append((ENHANCED, {}))
                told[-1][1][number] = told[-1][1].get(number, 0) + 1
        at += size
    return [(chunk, stop, first, pickle.dumps((start_order, told)))], used, pickle.dumps((at, reader.order))


def _pcapng_contexts(found: DataFrame) -> DataFrame:
    """(path, number, stop, first, count, context): the interfaces that each split begins with, and
    its packets under them.

    Only splits that declare something matter to later ones; a file has few of these, and they are
    put in order within the file once. All others take what the last such split left.
    """
    from pyspark.sql import Window

    schema = "path STRING, number BIGINT, after BINARY"

    def declared(batches):
        for batch in batches:
            rows = [r for r in batch.to_pylist() if any(k != ENHANCED for k, _ in pickle.loads(r["told"])[1])]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("path", "number", "told")} for r in rows], schema=_TOLD)

    def left(table: pa.Table) -> pa.Table:
        state, out = PcapngState(), []
        for r in sorted(table.to_pylist(), key=lambda r: r["number"]):
            for kind, what in pickle.loads(r["told"])[1]:
                if kind == SECTION:
                    state = PcapngState(what)
                elif kind == INTERFACE:
                    state.interfaces.append(what)
            out.append({"path": r["path"], "number": r["number"], "after": pickle.dumps((state.order, state.interfaces))})
        return pa.Table.from_pylist(out, schema=pa.schema([("path", pa.string()), ("number", pa.int64()), ("after", pa.binary())]))

    speaking = found.select("path", "number", "told").mapInArrow(declared, "path STRING, number BIGINT, told BINARY")
    after = cut_lineage(speaking.groupBy("path").applyInArrow(left, schema), "interfaces")
    line = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    joined = found.join(after, ["path", "number"], "left")
    joined = joined.withColumn("context", F.last("after", ignorenulls=True).over(line)).drop("after")

    def count(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                order, told = pickle.loads(r["told"])
                state = PcapngState(*pickle.loads(r["context"])) if r["context"] else PcapngState(order)
                context, n = pickle.dumps((order, list(state.interfaces))), 0
                for kind, what in told:
                    if kind == SECTION:
                        state = PcapngState(what)
                    elif kind == INTERFACE:
                        state.interfaces.append(what)
                    else:
                        n += sum(c for i, c in what.items() if i < len(state.interfaces))
                out.append({**{k: r[k] for k in ("path", "number", "stop", "first")}, "count": n, "context": context})
            yield pa.RecordBatch.from_pylist(out, schema=_INDEXED)

    return joined.select("path", "number", "stop", "first", "told", "context").mapInArrow(count, INDEX)


INDEX = "path STRING, number BIGINT, stop BIGINT, first BIGINT, count BIGINT, context BINARY"
_TOLD = pa.schema([("path", pa.string()), ("number", pa.int64()), ("told", pa.binary())])
_INDEXED = pa.schema(
    [("path", pa.string()), ("number", pa.int64()), ("stop", pa.int64()), ("first", pa.int64()), ("count", pa.int64()), ("context", pa.binary())]
)


def _splits(files: DataFrame, split_bytes: int, step, out: str) -> DataFrame:
    """What ``step`` finds in every byte split of ``files``, each begun where the one before ends."""
    last = F.expr(f"(length - 1) div {split_bytes}")
    splits = files.select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("split"))
    splits = splits.select(
        "path", "split", (F.col("split") * split_bytes).alias("begin"),
        F.least(F.col("length"), (F.col("split") + 1) * split_bytes).alias("stop"),
    )
    return carry(splits, ["path"], "split", ["begin"], ["path", "begin", "stop"], step, out)


def read_split(split: dict, columns: list[str] | None = None, keep=None) -> Iterator[pa.RecordBatch]:
    """The packets of one row of ``capture_index``."""
    source = _Window(_Remote(split["path"]))
    where = (_Rows(split["path"], columns, keep), split["first"], split["stop"], split["seq"])
    if split["format"] == "pcap":
        yield from _read_pcap(source, PcapLayout.parse(source.read_at(24, 0)), *where)
    else:
        yield from _read_pcapng(source, PcapngState(*pickle.loads(split["context"])), *where)


def capture_index(spark: SparkSession, *paths: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, format, first, stop, seq, count, context): the splits with packets of the capture files at
    ``paths`` (folders and globs allowed), each with the place and number of its first record.
    """
    from pyspark.sql import Window

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    files = listed.filter("length > 0").select("path", "length")
    # The first bytes of each file tell its format; tiny reads, spread over the cluster.
    schema = "path STRING, length BIGINT, format STRING"

    def formats(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            heads = [_Remote(n).read_at(24, 0) for n in names]
            kinds = [
                "pcapng" if h[:4] == PCAPNG_MAGIC
                else "pcap" if h[:4] in PCAP_MAGICS and len(h) == 24 else None
                for h in heads
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kinds, pa.string())],
                names=["path", "length", "format"],
            )

    files = files.mapInArrow(formats, schema)
    found = "number BIGINT, stop BIGINT, first BIGINT"
    classic = _splits(files.filter("format = 'pcap'"), split_bytes, _pcap_split, f"{found}, count BIGINT, context BINARY")
    blocks = _splits(files.filter("format = 'pcapng'"), split_bytes, _pcapng_split, f"{found}, told BINARY")
    index = classic.withColumn("format", F.lit("pcap"))
    index = index.unionByName(_pcapng_contexts(blocks).withColumn("format", F.lit("pcapng")))
    before = Window.partitionBy("path").orderBy("number")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    index = index.withColumn("seq", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return index.filter("count > 0").select("path", "format", "first", "stop", "seq", "count", "context")


def read_captures(spark: SparkSession, *paths: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Packets of capture files at ``paths`` (folders and globs allowed), in splits of ``split_bytes``."""
    # Splits go round robin over the tasks, so the splits of one file do not share a task.
    index = capture_index(spark, *paths, split_bytes=split_bytes).repartition(F.rand(7))

    def read(batches):
        for batch in batches:
            for split in batch.to_pylist():
                yield from read_split(split)

    # The planner takes the packets for as small as their index and would broadcast them.
    return index.mapInArrow(read, PACKETS).hint("merge")
