"""DNS messages in wire form to structs, a whole Arrow batch at a time.

Spark partitions the messages; inside a task the batch is one byte buffer and numpy moves
a cursor per message in lock step: all headers at once, then all first questions, and so
on. There is no Python loop over messages.
"""

from __future__ import annotations

import ipaddress

import numpy as np
import pyarrow as pa

MAX_LABELS = 255
MAX_POINTERS = 126
# Characters written with a backslash in name text.
SPECIAL = np.zeros(256, dtype=bool)
SPECIAL[np.frombuffer(b".  '@;()\"\\", dtype=np.uint8)] = True

SECTIONS = ("answer", "ns", "extra")
A, NS, CNAME, SOA, PTR, MX, TXT, AAAA, SRV, DNAME, OPT, SPF, CAA = (
    1, 2, 5, 6, 12, 15, 16, 28, 33, 39, 41, 99, 257,
)

QUESTION_TYPE = pa.struct([("name", pa.string()), ("qtype", pa.int32()), ("qclass", pa.int32())])
RECORD_TYPE = pa.struct(
    [
        ("name", pa.string()),
        ("rrtype", pa.int32()),
        ("class", pa.int32()),
        ("ttl", pa.int64()),
        ("rdlength", pa.int32()),
        ("rdata", pa.string()),
    ]
)


class Buffer:
    """The bytes of a batch of values with the span of each."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
        offsets = offsets[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        flat = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, np.uint8)
        # A little padding lets fixed-width reads run past the end; spans catch them.
        self.data = np.concatenate([flat, np.zeros(16, np.uint8)])
        self.begin, self.end = offsets[:-1].copy(), offsets[1:].copy()

    def read(self, at: np.ndarray, width: int) -> np.ndarray:
        at = np.minimum(at, len(self.data) - width)
        value = np.zeros(len(at), dtype=np.int64)
        for i in range(width):
            value = (value << 8) | self.data[at + i]
        return value


def _gather(data: np.ndarray, src: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenate ``data[src:src+size]`` of every span."""
    total = int(size.sum())
    shift = src - (np.cumsum(size) - size)
    return data[np.repeat(shift, size) + np.arange(total)]


def _join_bytes(flat: np.ndarray, sizes: np.ndarray, kind=pa.string()) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    big = pa.large_string() if kind == pa.string() else pa.large_binary()
    array = pa.Array.from_buffers(
        big, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]
    )
    return array.cast(kind)


def _escape(flat: np.ndarray, plain: np.ndarray, special: np.ndarray):
    """Write non-printing bytes as ``\\DDD`` and special ones with a backslash.

    ``plain`` marks bytes to leave alone. Returns the new bytes and each old byte's width.
    """
    odd = ((flat < 0x20) | (flat > 0x7E)) & ~plain
    marked = special[flat] & ~plain & ~odd
    width = np.where(odd, 4, np.where(marked, 2, 1))
    end = np.cumsum(width)
    out = np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    out[end - 1] = flat
    out[end[marked] - 2] = 0x5C
    at, value = end[odd], flat[odd].astype(np.int64)
    out[at - 4] = 0x5C
    out[at - 3] = 0x30 + value // 100
    out[at - 2] = 0x30 + value // 10 % 10
    out[at - 1] = 0x30 + value % 10
    return out, width


def read_names(buf: Buffer, at: np.ndarray, end: np.ndarray, base: np.ndarray):
    """Names at positions ``at``: (ok, position after the name, text array).

    ``base`` and ``end`` are the message bounds; compression pointers count from ``base``.
    """
    n = len(at)
    ok = np.ones(n, dtype=bool)
    after = np.full(n, -1, dtype=np.int64)
    cursor = at.astype(np.int64).copy()
    hops = np.zeros(n, dtype=np.int64)
    budget = np.full(n, MAX_LABELS, dtype=np.int64)
    live = np.arange(n)
    owners, sources, sizes = [], [], []
    while len(live):
        pos, stop = cursor[live], end[live]
        inside = pos < stop
        ok[live[~inside]] = False
        live, pos, stop = live[inside], pos[inside], stop[inside]
        size = buf.read(pos, 1)
        kind = size & 0xC0

        is_pointer = kind == 0xC0
        jumps = live[is_pointer]
        if len(jumps):
            jump_pos = pos[is_pointer]
            fits = jump_pos + 2 <= stop[is_pointer]
            target = base[jumps] + (buf.read(jump_pos, 2) & 0x3FFF)
            first = after[jumps] < 0
            after[jumps[first]] = jump_pos[first] + 2
            cursor[jumps] = target
            hops[jumps] += 1
            ok[jumps[~fits | (hops[jumps] > MAX_POINTERS)]] = False

        is_label = kind == 0
        labels, label_pos, label_size = live[is_label], pos[is_label], size[is_label]
        done = label_size == 0
        finished = labels[done]
        open_end = after[finished] < 0
        after[finished[open_end]] = label_pos[done][open_end] + 1
        more = labels[~done]
        if len(more):
            more_pos, more_size = label_pos[~done], label_size[~done]
            budget[more] -= more_size + 1
            fits = (more_pos + 1 + more_size <= end[more]) & (budget[more] > 0)
            ok[more[~fits]] = False
            cursor[more] = more_pos + 1 + more_size
            owners.append(more[fits])
            sources.append(more_pos[fits] + 1)
            sizes.append(more_size[fits])
        ok[live[~is_pointer & ~is_label]] = False
        going = np.concatenate([jumps, more])
        live = going[ok[going]]

    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    source = np.concatenate(sources) if sources else np.zeros(0, np.int64)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    # The root name has no label; an empty one yields its single dot.
    bare = np.setdiff1d(np.arange(n), owner)
    owner = np.concatenate([owner, bare])
    source = np.concatenate([source, np.zeros(len(bare), np.int64)])
    size = np.concatenate([size, np.zeros(len(bare), np.int64)])
    order = np.argsort(owner, kind="stable")
    owner, source, size = owner[order], source[order], size[order]
    # One byte after each label becomes its dot.
    flat = _gather(buf.data, source, size + 1).copy()
    label_end = np.cumsum(size + 1)
    dots = np.zeros(len(flat), dtype=bool)
    dots[label_end - 1] = True
    flat[dots] = 0x2E
    text, width = _escape(flat, dots, SPECIAL)
    ends = np.concatenate([[0], np.cumsum(width)])
    label_width = ends[label_end] - ends[label_end - size - 1]
    per_name = np.bincount(owner, weights=label_width, minlength=n).astype(np.int64)
    return ok, after, _join_bytes(text, per_name)


def _strings(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers).cast(pa.string())


def _concat(*parts, sep=" ") -> pa.Array:
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(*parts, sep)


def _addresses(buf: Buffer, at: np.ndarray, width: int) -> pa.Array:
    """Address text; each distinct address is formatted once."""
    raw = np.stack([buf.data[at + i] for i in range(width)], axis=1)
    keys, back = np.unique(np.ascontiguousarray(raw).view(f"V{width}").ravel(), return_inverse=True)
    text = pa.array([str(ipaddress.ip_address(bytes(k))) for k in keys], pa.string())
    return text.take(pa.array(back.ravel()))


def _character_strings(buf: Buffer, at: np.ndarray, end: np.ndarray):
    """TXT-like data: length-prefixed strings as quoted text."""
    n = len(at)
    ok = np.ones(n, dtype=bool)
    cursor, live = at.copy(), np.arange(n)
    owners, sources, sizes = [], [], []
    while True:
        live = live[cursor[live] < end[live]]
        if not len(live):
            break
        size = buf.read(cursor[live], 1)
        fits = cursor[live] + 1 + size <= end[live]
        ok[live[~fits]] = False
        live, size = live[fits], size[fits]
        owners.append(live)
        sources.append(cursor[live] + 1)
        sizes.append(size)
        cursor[live] += 1 + size
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    source = (np.concatenate(sources) if sources else np.zeros(0, np.int64))[order]
    size = (np.concatenate(sizes) if sizes else np.zeros(0, np.int64))[order]
    special = np.zeros(256, dtype=bool)
    special[[0x22, 0x5C]] = True
    text, width = _escape(
        _gather(buf.data, source, size), np.zeros(int(size.sum()), dtype=bool), special
    )
    ends = np.concatenate([[0], np.cumsum(width)])
    stop = np.cumsum(size)
    pieces = _join_bytes(text, ends[stop] - ends[stop - size])
    quoted = _concat(pa.array(['"'] * len(owner), pa.string()), pieces,
                     pa.array(['"'] * len(owner), pa.string()), sep="")
    import pyarrow.compute as pc

    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), quoted)
    return ok, pc.binary_join(lists, " ")


def _generic(buf: Buffer, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Unknown types in the generic form ``\\# length hex``."""
    digits = np.frombuffer(b"0123456789ABCDEF", dtype=np.uint8)
    flat = _gather(buf.data, at, size)
    hexed = np.empty(2 * len(flat), dtype=np.uint8)
    hexed[0::2], hexed[1::2] = digits[flat >> 4], digits[flat & 15]
    mark = pa.array(["\\#"] * len(at), pa.string())
    return _concat(mark, _strings(size), _join_bytes(hexed, 2 * size))


def _rdata_of(buf, rrtype, at, size, base, end):
    """(ok, text) of record data that all has one type and is not empty."""
    stop = at + size
    if rrtype in (A, AAAA):
        width = 4 if rrtype == A else 16
        ok = size == width
        text = _addresses(buf, np.where(ok, at, 0), width)
        return ok, text
    if rrtype in (NS, CNAME, PTR, DNAME):
        ok, after, text = read_names(buf, at, end, base)
        return ok & (after == stop), text
    if rrtype == MX:
        ok, after, text = read_names(buf, at + 2, end, base)
        return ok & (after == stop), _concat(_strings(buf.read(at, 2)), text)
    if rrtype == SRV:
        ok, after, text = read_names(buf, at + 6, end, base)
        numbers = [_strings(buf.read(at + i, 2)) for i in (0, 2, 4)]
        return ok & (after == stop), _concat(*numbers, text)
    if rrtype == SOA:
        ok1, mid, host = read_names(buf, at, end, base)
        ok2, tail, mail = read_names(buf, np.where(ok1, mid, end), end, base)
        tail = np.where(ok1 & ok2, tail, 0)
        numbers = [_strings(buf.read(tail + i, 4)) for i in (0, 4, 8, 12, 16)]
        return ok1 & ok2 & (tail + 20 == stop), _concat(host, mail, *numbers)
    if rrtype in (TXT, SPF):
        return _character_strings(buf, at, stop)
    if rrtype == CAA:
        tag_size = buf.read(at + 1, 1)
        ok = 2 + tag_size <= size
        tag_size, value_size = np.where(ok, tag_size, 0), np.where(ok, size - 2 - tag_size, 0)
        tag = _join_bytes(_gather(buf.data, at + 2, tag_size) & 0x7F, tag_size)
        value = _join_bytes(_gather(buf.data, at + 2 + tag_size, value_size) & 0x7F, value_size)
        quote = pa.array(['"'] * len(at), pa.string())
        quoted = _concat(quote, value, quote, sep="")
        return ok, _concat(_strings(buf.read(at, 1)), tag, quoted)
    return np.ones(len(at), dtype=bool), _generic(buf, at, size)


def _record_data(buf, rows, rrtype, at, size, base, end):
    """Text of all record data, one type at a time; also the records that are malformed."""
    bad = np.zeros(len(rows), dtype=bool)
    pieces, places = [], []
    filled = size > 0
    empty = np.flatnonzero(~filled)
    pieces.append(pa.array([""] * len(empty), pa.string()))
    places.append(empty)
    for kind in np.unique(rrtype[filled]):
        mine = np.flatnonzero(filled & (rrtype == kind))
        ok, text = _rdata_of(buf, int(kind), at[mine], size[mine], base[mine], end[mine])
        bad[mine[~ok]] = True
        pieces.append(text)
        places.append(mine)
    place = np.concatenate(places)
    back = np.empty(len(place), dtype=np.int64)
    back[place] = np.arange(len(place))
    return bad, pa.chunked_array(pieces).combine_chunks().take(pa.array(back))


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Group ``values`` by row; rows without any get an empty list."""
    order = np.argsort(rows, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(order)))


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _text(parts: list[pa.Array]) -> pa.Array:
    return pa.chunked_array(parts, pa.string()).combine_chunks() if parts else pa.array([], pa.string())


def decode_messages(column: pa.Array) -> tuple[pa.StructArray, pa.Array]:
    """Decode a batch: (message structs, error text). Exactly one of the two is NULL."""
    buf = Buffer(column)
    n = len(buf.begin)
    base, end = buf.begin, buf.end
    present = end - base >= 12
    failed = ~present
    reason = np.where(present, "", "short message").astype(object)
    head = np.where(present, base, 0)
    flags = buf.read(head + 2, 2)
    pos = head + 12
    # Header only: the counts do not matter.
    reading = present & (pos < end)

    def fail(rows, why):
        failed[rows] = True
        reason[rows] = why

    q_rows, q_names, q_types, q_classes = [], [], [], []
    wanted = buf.read(head + 4, 2)
    step = 0
    while True:
        live = np.flatnonzero(reading & ~failed & (wanted > step) & (pos < end))
        if not len(live):
            break
        ok, after, names = read_names(buf, pos[live], end[live], base[live])
        fail(live[~ok], "bad question name")
        at = np.where(ok, after, end[live])
        fields = []
        for _ in range(2):
            # A message may end exactly before a field; the field is then zero.
            ends_here = at == end[live]
            short = ~ends_here & (at + 2 > end[live])
            fail(live[short], "truncated question")
            fields.append(np.where(ends_here | short, 0, buf.read(at, 2)))
            at = np.where(ends_here | short, end[live], at + 2)
        pos[live] = at
        q_rows.append(live)
        q_names.append(names)
        q_types.append(fields[0])
        q_classes.append(fields[1])
        step += 1

    parts = {k: [] for k in ("section", "row", "type", "class", "ttl", "size", "at")}
    names_all = []
    for section in range(3):
        wanted = buf.read(head + 6 + 2 * section, 2)
        step = 0
        while True:
            live = np.flatnonzero(reading & ~failed & (wanted > step) & (pos < end))
            if not len(live):
                break
            ok, after, names = read_names(buf, pos[live], end[live], base[live])
            fail(live[~ok], "bad record name")
            at = np.where(ok, after, 0)
            whole = ok & (at + 10 <= end[live])
            fail(live[ok & ~whole], "truncated record")
            at = np.where(whole, at, 0)
            size = np.where(whole, buf.read(at + 8, 2), 0)
            fits = at + 10 + size <= end[live]
            fail(live[whole & ~fits], "overflowing record data")
            keep = whole & fits
            parts["section"].append(np.full(int(keep.sum()), section))
            parts["row"].append(live[keep])
            parts["type"].append(buf.read(at, 2)[keep])
            parts["class"].append(buf.read(at + 2, 2)[keep])
            parts["ttl"].append(buf.read(at + 4, 4)[keep])
            parts["size"].append(size[keep])
            parts["at"].append(at[keep] + 10)
            names_all.append(names.filter(pa.array(keep)))
            pos[live[keep]] = (at + 10 + size)[keep]
            step += 1

    rec = {k: _stack(v) for k, v in parts.items()}
    rec_names = _text(names_all)
    bad, rdata = _record_data(
        buf, rec["row"], rec["type"], rec["at"], rec["size"], base[rec["row"]], end[rec["row"]]
    )
    fail(rec["row"][bad], "bad record data")

    # The last OPT record of the extra section carries the upper response code bits.
    rcode = flags & 15
    opt = np.flatnonzero((rec["section"] == 2) & (rec["type"] == OPT))
    high = np.zeros(n, dtype=np.int64)
    high[rec["row"][opt]] = (rec["ttl"][opt] >> 24) & 0xFF
    rcode = rcode | (high << 4)

    def i32(x):
        return pa.array(x.astype(np.int32))

    def bit(mask):
        return pa.array((flags & mask) != 0)

    question = pa.StructArray.from_arrays(
        [_text(q_names), i32(_stack(q_types)), i32(_stack(q_classes))], fields=list(QUESTION_TYPE)
    )
    lists = []
    for section in range(3):
        mine = np.flatnonzero(rec["section"] == section)
        take = pa.array(mine)
        records = pa.StructArray.from_arrays(
            [
                rec_names.take(take), i32(rec["type"][mine]), i32(rec["class"][mine]),
                pa.array(rec["ttl"][mine]), i32(rec["size"][mine]), rdata.take(take),
            ],
            fields=list(RECORD_TYPE),
        )
        lists.append(_lists(rec["row"][mine], n, records))
    columns = {
        "id": i32(buf.read(head, 2)), "response": bit(0x8000), "opcode": i32((flags >> 11) & 15),
        "authoritative": bit(0x400), "truncated": bit(0x200), "recursion_desired": bit(0x100),
        "recursion_available": bit(0x80), "zero": bit(0x40), "authenticated_data": bit(0x20),
        "checking_disabled": bit(0x10), "rcode": i32(rcode),
        "question": _lists(_stack(q_rows), n, question),
        "answer": lists[0], "ns": lists[1], "extra": lists[2],
    }
    messages = pa.StructArray.from_arrays(
        list(columns.values()), names=list(columns), mask=pa.array(failed)
    )
    return messages, pa.array([r if f else None for r, f in zip(reason, failed)], pa.string())
