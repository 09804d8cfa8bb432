"""The capture plan: packets to results, all paths merged."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namestrata.functions.arrow_steps import keep
from namestrata.operators.counters import Counters, watched
from namestrata.operators.headers import TCP, UDP, ip_datagrams, on_port, transport
from namestrata.operators.messages import merge_results, tcp_records, udp_records
from namestrata.operators.reassembly import reassemble_fragments, tcp_messages
from namestrata.operators.sampling import sample_records, sample_then_drop_copies
from namestrata.schemas import DNS_RESULT_COLUMNS
from namestrata.session import cut_lineage


def packets_to_results(
    packets: DataFrame,
    port: int = 53,
    ratio: str = "1:1",
    dedup_seconds: int | None = None,
    mask_v4: int = 32,
    mask_v6: int = 128,
    defrag: bool = True,
    tcp: bool = True,
    ethernet: bool | None = None,
    counters: Counters | None = None,
    columns: list[str] = DNS_RESULT_COLUMNS,
) -> DataFrame:
    """Sample, drop copies, decode headers, reassemble, decode messages, mask.

    Sampling and copies come before any decoding, the port filter before any message leaves
    the JVM. The record number of the capture is the sampling counter. ``counters`` get
    packetsCaptured, packetsOverRatio and packetsDuplicate where such a step is on,
    decodingErrors, unpackErrors and messagesDecoded. ``columns`` are those of the results that are read;
    the others are not handed over.
    """
    if dedup_seconds:
        packets = sample_then_drop_copies(
            packets, ratio, number="seq", counters=counters, seconds=dedup_seconds, by=("file",)
        )
        if defrag or tcp:
            # Finding copies shuffles the packets; what is left is stored, not found twice.
            packets = cut_lineage(packets, "survivors")
    elif ratio != "1:1":
        packets = sample_records(packets, ratio, number="seq", counters=counters)
    datagrams = ip_datagrams(packets, ethernet)
    datagrams = watched(counters, datagrams, decodingErrors=F.col("error").isNotNull())
    datagrams = keep(datagrams, F.col("error").isNull(), lambda b: pc.is_null(b.column("error")))
    whole = keep(
        datagrams, ~F.col("is_fragment") & (F.col("protocol_no") == UDP),
        lambda b: pc.and_kleene(pc.invert(b.column("is_fragment")), pc.equal(b.column("protocol_no"), UDP)),
    )
    parts = [udp_records(on_port(transport(whole, counters), port), mask_v4, mask_v6, counters, columns)]
    if not (defrag or tcp):
        return parts[0]
    # What needs reassembly is a small share: it is set aside in one pass over the capture, so
    # the capture itself is read twice in all, whatever the number of paths.
    rest = keep(
        datagrams, F.col("is_fragment") | (F.col("protocol_no") == TCP),
        lambda b: pc.or_kleene(b.column("is_fragment"), pc.equal(b.column("protocol_no"), TCP)),
    )
    rest = cut_lineage(rest, "reassembly")
    fragments, segments = rest.agg(F.count_if("is_fragment"), F.count_if(~F.col("is_fragment"))).first()
    late = None
    if defrag and fragments:
        # Rebuilt once, for both protocols.
        rebuilt = cut_lineage(reassemble_fragments(rest, stored=True), "rebuilt")
        udp = transport(rebuilt.filter(f"protocol_no = {UDP}"), counters)
        parts.append(udp_records(on_port(udp, port), mask_v4, mask_v6, counters, columns))
        late = on_port(transport(rebuilt.filter(f"protocol_no = {TCP}"), counters), port)
    if tcp and (segments or late is not None):
        flows = on_port(transport(rest.filter("NOT is_fragment"), counters), port)
        if late is not None:
            flows = flows.unionByName(late, allowMissingColumns=True)
        parts.append(tcp_records(tcp_messages(flows), mask_v4, mask_v6, counters, columns))
    return merge_results(*parts)
