"""Headers of whole batches against a reader of one packet, on packets cut and damaged anywhere."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from namestrata.functions.byte_rows import ByteRows
from namestrata.operators import headers, messages
from namestrata.plans import traffic
from tests.conftest import SF


def number(data, at, width):
    return int.from_bytes(data[at : at + width], "big") if at + width <= len(data) else None


def one(data, ethernet):
    """(family, source, destination, protocol, id, offset, more, payload) of a packet without VXLAN."""
    l3 = 0
    if ethernet:
        l3 = 14
        while data[l3 - 2 : l3] in (b"\x81\0", b"\x88\xa8"):
            l3 += 4
        family = {b"\x08\0": 4, b"\x86\xdd": 6}.get(data[l3 - 2 : l3])
    else:
        family = data[0] >> 4 if data and data[0] >> 4 in (4, 6) else None
    if family is None:
        return None, None, None, None, None, 0, False, b""
    if family == 4:
        first, length, protocol = number(data, l3, 1), number(data, l3 + 2, 2), number(data, l3 + 9, 1)
        flags, ip_id = number(data, l3 + 6, 2), number(data, l3 + 4, 2)
        ends = data[l3 + 12 : l3 + 16], data[l3 + 16 : l3 + 20]
        if first is None:
            return family, *ends, protocol, ip_id, 0, False, None
        ihl, offset, more = (first & 15) * 4, (flags or 0) & 0x1FFF, bool((flags or 0) & 0x2000)
        payload = data[l3 + ihl : l3 + ihl + max(0, (length or 0) - ihl)]
        return family, *ends, protocol, ip_id, offset, more, payload
    length, protocol, ihl = number(data, l3 + 4, 2), number(data, l3 + 6, 1), 40
    ends = data[l3 + 8 : l3 + 24], data[l3 + 24 : l3 + 40]
    if protocol == 0:
        words, protocol = number(data, l3 + 41, 1), number(data, l3 + 40, 1)
        if words is None:
            return family, *ends, None if protocol == 44 else protocol, None, 0, False, None
        ihl = 48 + 8 * words
    l4, ip_id, offset, more, skipped = l3 + ihl, None, 0, False, 0
    if protocol == 44:
        flags, ip_id, protocol, skipped = number(data, l4 + 2, 2), number(data, l4 + 4, 4), number(data, l4, 1), 8
        offset, more = (flags or 0) >> 3, bool((flags or 0) & 1)
    width = 0 if length is None else max(0, length + 40 - ihl - skipped)
    return family, *ends, protocol, ip_id, offset, more, data[l4 + skipped : l4 + skipped + width]


def damaged(spark):
    rng, out = random.Random(4), []
    events = traffic.load_events(spark, SF).filter("event_id < 60")
    made = [m(events) for m in (traffic.udp_packets_of, traffic.fragment_packets_of, traffic.tcp_packets_of)]
    base = [(r.link_type == 1, bytes(r.data)) for m in made for r in m.collect()]
    base += [(e, d[:12] + b"\x88\xa8\0\1\x81\0\0\2" + d[12:]) for e, d in base if e]
    base += [
        (e, d[:20] + b"\0" + d[21:54] + d[20:21] + bytes([w]) + bytes(6 + 8 * w) + d[54:])
        for e, d in base if d[12:14] == b"\x86\xdd" for w in (0, 1)
    ]
    for _ in range(4000):
        ethernet, data = rng.choice(base)
        data = bytearray(data[: rng.randrange(len(data) + 1)] if rng.random() < 0.6 else data)
        for _ in range(rng.randrange(3)):
            if data:
                data[rng.randrange(min(len(data), 64))] = rng.choice([0, 1, 6, 17, 44, 0x45, 0x4F, 0x60, 0x81, rng.randrange(256)])
        out.append((ethernet, bytes(data)))
    return [*base, *out, (True, b""), (False, b"")]


def test_headers_of_cut_packets(spark):
    rows = damaged(spark)
    made = headers._ip_fields(
        ByteRows(pa.array([d for _, d in rows], pa.binary())), np.array([e for e, _ in rows]), vxlan=False
    )
    got = list(zip(*[made[i].to_pylist() for i in (0, 1, 2, 3, 4, 5, 6, 8)]))
    assert got == [one(d, e) for e, d in rows]


def test_steps_cross_to_python_once(spark):
    """Headers, ports and messages of one capture: one exchange with Python, as many rows as with one each."""
    packets = traffic.udp_packets(spark, SF).localCheckpoint()

    def path(rows, cut):
        rows = cut(headers.ip_datagrams(cut(rows)))
        rows = cut(headers.on_port(cut(headers.transport(rows))))
        return messages.udp_records(rows)

    whole, apart = path(packets, lambda df: df), path(packets, lambda df: df.filter("true OR seq = 0"))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert whole.columns == apart.columns and whole.schema == apart.schema
    left, right = [df.withColumn("dns", F.to_json("dns")) for df in (whole, apart)]
    assert left.count() > 800 and left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0
    few = messages.udp_records(headers.on_port(headers.transport(headers.ip_datagrams(packets))), columns=["seq", "src_ip"])
    assert few.columns == ["seq", "src_ip"] and few.exceptAll(whole.select("seq", "src_ip")).count() == 0
    assert few.count() == whole.count()
