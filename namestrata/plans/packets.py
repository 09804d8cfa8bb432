"""Packets of the sample traffic, rendered in Arrow batches.

The bytes are those of the records of :func:`namestrata.plans.traffic.results_of`, packed by
:mod:`namestrata.functions.wire`, without a record being built first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namestrata.functions.arrow_steps import then
from namestrata.schemas import LINK_ETHERNET, PACKETS

LINK_RAW = 101
VXLAN_ENDS = ("0A090001", "0A090002")

#: (order in the event, microseconds after it, nanoseconds, link type, bytes) of one packet.
Packet = tuple[int | None, int, int | None, int, bytes | None]

#: Events rendered at once, a few megabytes of packets.
EVENTS_AT_ONCE = 4096

TOKEN = re.compile(r"\\[0-9]{3}|\\[^\n\r\u0085\u2028\u2029]|[^\\]")


def packets_of(events: DataFrame, render: Callable[[dict], Iterator[Packet]]) -> DataFrame:
    """Every event's packets, as a capture has them."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("event_id", us.alias("us"), "user_id", "event_type")

    def job(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, EVENTS_AT_ONCE):
                made = list(render(_columns(batch.slice(at, EVENTS_AT_ONCE))))
                seq, micros, ns, link, frames = zip(*made) if made else ((),) * 5
                data = pa.array(frames, pa.binary())
                size = pc.binary_length(data)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["capture"] * len(made), pa.string()), pa.array(seq, pa.int64()),
                        pa.array(micros, pa.timestamp("us", "UTC")), pa.array(ns, pa.int64()), size, size,
                        pa.array(link, pa.int32()), data,
                    ],
                    names=schema.names,
                )

    schema = T.DataType.fromDDL(f"STRUCT<{PACKETS}>")
    return then(rows, job, schema)


def _columns(batch: pa.RecordBatch) -> dict:
    """What the packets of all kinds need of the events, a list each; remainders have the sign of SQL."""
    ids = batch.column("event_id")
    known = np.asarray(ids.is_valid())
    e = np.asarray(ids.fill_null(0), dtype=np.int64)
    users, kinds = batch.column("user_id"), batch.column("event_type").to_pylist()
    there = np.asarray(users.is_valid())
    u = np.asarray(users.fill_null(0), dtype=np.int64)
    error = np.asarray(batch.column("event_type").fill_null("").to_numpy(zero_copy_only=False) == "error", dtype=bool)

    def every(n: int, rest: int = 0) -> np.ndarray:
        return np.fmod(e, n) == rest

    is6, response, edns = every(5), every(3), every(2)
    flags = np.where(every(50, 7), 5 << 11, 0) | np.where(error, 3, 0) | np.where(response, 0x8080, 0)
    for condition, bit in (
        (response & every(2, 1), 0x400), (every(61), 0x200), (~every(8), 0x100), (every(9), 0x20), (every(12), 0x10),
    ):
        flags |= np.where(condition, bit, 0)
    asked = np.where(every(13, 5), 0, np.where(every(11), 2, 1))
    authority = response & every(6)
    head = np.stack(
        [np.mod(e * 31, 65536), flags, asked, np.where(response, 2, 0), np.where(authority, 2, 0), np.where(edns, 1, 0)], 1
    ).astype(">u2").tobytes()
    kind = np.fmod(e, 7)
    qtype = np.select([kind == 0, kind == 1, kind == 2, kind == 3], [28, 16, 15, 4321], 1)
    asks = np.stack([qtype, np.where(every(97), 3, 1)], 1).astype(">u2").tobytes()
    number = np.fmod(e * 7919, 2003).tolist()
    even = (np.fmod(u, 2) == 0) & there
    ends = [EXAMPLE if x else SAMPLE for x in even.tolist()]
    names = [None if k is None else _question(k, str(n), *end) for k, n, end in zip(kinds, number, ends)]
    low = np.stack([np.fmod(u, 7), np.fmod(u, 250)], 1).astype(np.uint8).tobytes()
    host6, end6 = np.fmod(u, 10).astype(">i8").tobytes(), (np.fmod(e, 3) + 0x35).astype(">i8").tobytes()
    end4 = (np.fmod(e, 3) + 1).astype(np.uint8).tobytes()
    answers, parts = response.tolist(), authority.tolist()
    kind4, host = np.fmod(e, 4).tolist(), np.fmod(e, 17).tolist()
    ttl = np.fmod(e, 86400).astype(">i4").tobytes()
    ids, opt, sure, do = e.tolist(), edns.tolist(), known.tolist(), every(4).tolist()
    src, dst, wires = [], [], []
    for i, six in enumerate(is6.tolist()):
        if six and sure[i]:
            src.append(NET6 + host6[8 * i : 8 * i + 8])
            dst.append(NET6 + end6[8 * i : 8 * i + 8])
        else:
            src.append(b"\x0a\0" + low[2 * i : 2 * i + 2])
            dst.append(b"\xc0\0\x02" + end4[i : i + 1])
        if not sure[i]:
            wires.append(None)
            continue
        name, out = names[i], [head[12 * i : 12 * i + 12]]
        # Records without a name are counted, but have no bytes.
        if name is not None:
            if asked[i]:
                out += (name, asks[4 * i : 4 * i + 4])
                if asked[i] == 2:
                    out += (b"\x03alt", name, b"\0\x01\0\x01")
            if answers[i]:
                n, life = ids[i], ttl[4 * i : 4 * i + 4]
                label = b"host%d" % host[i]
                target = bytes((len(label),)) + label + b"\x07example\x03net\0"
                out += (name, _record(b"\0\x05", life, target))
                rrtype, data = _second(n, kind4[i], target)
                out += (name, _record(rrtype, life, data))
                if parts[i]:
                    soa = target + b"\x05admin\x07example\x03net\0" + (n & 0xFFFFFFFF).to_bytes(4, "big") + TIMES
                    out += (name, _record(b"\0\x06", life, soa), name, _record(b"\0\x02", life, target))
        if opt[i]:
            out.append(OPT_DO if do[i] else OPT)
        wires.append(b"".join(out))
    # Addresses without a user are unknown, and so is the packet.
    gone = [not (a and b) for a, b in zip(sure, there.tolist())]
    return {
        "e": [n if k else None for n, k in zip(ids, sure)], "us": batch.column("us").to_pylist(), "gone": gone,
        "src": src, "dst": dst, "wire": wires, "response": answers, "tcp": every(10).tolist(),
        "mod": lambda n: np.fmod(e, n).tolist(),
    }


EXAMPLE = ("Example.com.", b"\x07Example\x03com\0")
SAMPLE = ("sample.org.", b"\x06sample\x03org\0")
NET6 = bytes.fromhex("20010DB800000000")
NET6_HALF = bytes.fromhex("20010DB8") + bytes(10)
OPT = bytes.fromhex("00002904D0000000000000")
OPT_DO = bytes.fromhex("00002904D0000080000000")
TIMES = b"".join(n.to_bytes(4, "big") for n in (7200, 3600, 1209600, 300))


def _record(kind: bytes, ttl: bytes, data: bytes) -> bytes:
    return kind + b"\0\x01" + ttl + len(data).to_bytes(2, "big") + data


def _second(n: int, kind: int, target: bytes) -> tuple[bytes, bytes]:
    """Type and data of the second answer."""
    if kind == 0:
        # A negative one has 16 digits as text, of which an address takes four.
        host = _rest(n, 4096) + 1
        return b"\0\x1c", NET6_HALF + (_u2(host) if host >= 0 else b"\xff\xff")
    if kind == 1:
        return b"\0\x0f", _u2(_rest(n, 90)) + target
    if kind == 2:
        text = b"v=spf1 id=%d" % n
        return b"\0\x10", bytes((len(text),)) + text + b"\x06second"
    return b"\0\x01", b"\xcb\0\x71" + bytes((_rest(n, 250) & 0xFF,))


def _rest(n: int, of: int) -> int:
    """The remainder as SQL has it, with the sign of ``n``."""
    return n % of if n >= 0 else -(-n % of)


def _question(kind: str, number: str, text: str, ending: bytes) -> bytes:
    """``kind`` and ``number`` as a label in front of a domain."""
    if "\\" in kind:
        return _name(f"{kind}{number}.{text}")
    if "." in kind:
        return b"".join(_label(p.encode()) for p in f"{kind}{number}".split(".") if p) + ending
    return _label((kind + number).encode()) + ending


def _label(label: bytes) -> bytes:
    # Two digits of the size are written, however many it has.
    return bytes.fromhex(f"{len(label):02X}"[:2]) + label


def _name(text: str) -> bytes:
    """A name with escapes, as :func:`namestrata.functions.wire.name_hex` packs it."""
    labels = [""]
    for token in TOKEN.findall(text):
        if token == ".":
            labels.append("")
        elif len(token) == 4:
            labels[-1] += f"{int(token[1:]):02X}"[:2]
        else:
            labels[-1] += token[-1].encode().hex().upper()
    return b"".join(_label(bytes.fromhex(x)) for x in labels if x) + b"\0"


# --- headers ---------------------------------------------------------------------------------


def _udp(src_port: int, dst_port: int, payload: bytes) -> bytes:
    return _u2(src_port) + _u2(dst_port) + _u2(len(payload) + 8) + b"\0\0" + payload


def _u2(number: int) -> bytes:
    return (number & 0xFFFF).to_bytes(2, "big")


def _ip(src: bytes, dst: bytes, protocol: bytes, body: bytes, ip_id: bytes = b"\0\0", offset: bytes = b"\0\0") -> bytes:
    """An IPv4 or IPv6 header in front of ``body``; the family follows the addresses."""
    if len(src) == 4:
        return b"".join(
            (b"\x45\0", _u2(len(body) + 20), ip_id, offset, b"\x40", protocol, b"\0\0", src, dst, body)
        )
    return b"".join((b"\x60\0\0\0", _u2(len(body)), protocol, b"\x40", src, dst, body))


LINK = bytes.fromhex("020000000001020000000002")


def _ethernet(src: bytes, inner: bytes, tags: bytes = b"") -> bytes:
    return LINK + tags + (b"\x08\0" if len(src) == 4 else b"\x86\xdd") + inner


# --- the three kinds of traffic --------------------------------------------------------------


def udp(c: dict) -> Iterator[Packet]:
    fifth, odd_port, cut = c["mod"](5), c["mod"](19), c["mod"](23)
    client, fine = c["mod"](60000), c["mod"](1000)
    outer = [bytes.fromhex(x) for x in VXLAN_ENDS]
    for i, e in enumerate(c["e"]):
        us, link = c["us"][i], LINK_ETHERNET
        raw = e is not None and fifth[i] == 4
        ns = None if us is None or e is None else us * 1000 + fine[i]
        if c["gone"][i]:
            yield e, us, ns, LINK_RAW if raw else LINK_ETHERNET, None
            continue
        wire, src = c["wire"][i], c["src"][i]
        ports = (53, 4000) if c["tcp"][i] else (53, 1024 + client[i]) if c["response"][i] else (1024 + client[i], 53)
        if odd_port[i] == 0:
            ports = 8080, 8081
        ip = _ip(src, c["dst"][i], b"\x11", _udp(*ports, wire))
        if fifth[i] == 1:
            frame = _ethernet(src, ip, b"\x81\0\0\x07")
        elif fifth[i] == 2:
            frame = _ethernet(src, ip, b"\x81\0\0\x07\x81\0\0\x09")
        elif fifth[i] == 3:
            body = b"\x08\0\0\0\0\0\x01\0" + _ethernet(src, ip)
            frame = _ethernet(outer[0], _ip(*outer, b"\x11", _udp(0xC000, 4789, body)))
        elif raw:
            frame, link = ip, LINK_RAW
        else:
            frame = _ethernet(src, ip)
        # Damage: the packet is cut inside its DNS header.
        yield e, us, ns, link, frame[: len(frame) - len(wire) + 5] if cut[i] == 0 else frame


def fragments(c: dict) -> Iterator[Packet]:
    lacks, again, fine = c["mod"](29), c["mod"](31), c["mod"](1000)
    for i, e in enumerate(c["e"]):
        us = c["us"][i]
        ns = None if us is None or e is None else us * 1000 + fine[i]
        gone = c["gone"][i]
        body, src, dst = b"" if gone else _udp(4000, 53, c["wire"][i]), c["src"][i], c["dst"][i]
        for copy, piece in enumerate((1, 0, 2, 0)):
            if (piece == 1 and (e is None or lacks[i] == 0)) or (copy == 3 and (e is None or again[i] != 0)):
                continue
            seq = None if e is None else e * 4 + copy
            if gone:
                yield seq, us, ns, LINK_ETHERNET, None
                continue
            # Cuts at 8 and 16 bytes: the shortest message, a bare header, still fills three pieces.
            part = body[16:] if piece == 2 else body[piece * 8 : piece * 8 + 8]
            if len(src) == 4:
                ip = _ip(src, dst, b"\x11", part, _u2(_rest(e, 65536)), _u2(2 if piece == 2 else 0x2000 + piece))
            else:
                place = piece << 3 | (0 if piece == 2 else 1)
                ip = _ip(src, dst, b"\x2c", b"\x11\0" + _u2(place) + (e & 0xFFFFFFFF).to_bytes(4, "big") + part)
            yield seq, us, ns, LINK_ETHERNET, _ethernet(src, ip)


def tcp(c: dict) -> Iterator[Packet]:
    client, late = c["mod"](60000), c["mod"](150)
    for i, e in enumerate(c["e"]):
        us = c["us"][i]
        if c["gone"][i]:
            for n in range(5):
                at_us = None if us is None else us + n * 1000
                yield None if e is None else e * 8 + n, at_us, None if us is None else at_us * 1000, LINK_ETHERNET, None
            continue
        wire, src, dst = c["wire"][i], c["src"][i], c["dst"][i]
        body = (_u2(len(wire)) + wire) * 3
        size = len(body)
        first, second = size // 4, size * 2 // 3
        # Initial numbers close to 2**32 make some streams wrap.
        isn = 4294967200 + late[i]
        # What comes before the length in the IP header, and between it and the number.
        if len(src) == 4:
            before, fixed = LINK + b"\x08\0\x45\0", 40
            after = b"\0\0\0\0\x40\x06\0\0" + src + dst
        else:
            before, fixed, after = LINK + b"\x86\xdd\x60\0\0\0", 20, b"\x06\x40" + src + dst
        after += _u2(1024 + client[i]) + b"\0\x35"
        for n, at, end, flags in (
            (0, 0, 0, 2), (1, first, second, 16), (2, 0, first, 16), (3, 0, first, 16), (4, second, size, 24),
        ):
            number = (isn + (0 if flags == 2 else at + 1)) & 0xFFFFFFFF
            # Arrivals a millisecond apart.
            at_us = None if us is None else us + n * 1000
            yield e * 8 + n, at_us, None if us is None else at_us * 1000, LINK_ETHERNET, b"".join(
                (
                    before, (fixed + end - at & 0xFFFF).to_bytes(2, "big"), after, number.to_bytes(4, "big"),
                    TCP_FLAGS[flags], body[at:end],
                )
            )


#: Acknowledgement, header size, flags, window, checksum and urgent pointer.
TCP_FLAGS = {f: b"\0\0\0\0\x50" + bytes((f,)) + b"\xff\xff\0\0\0\0" for f in (2, 16, 24)}
