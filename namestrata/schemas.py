"""Record layouts shared by all jobs."""

from __future__ import annotations

QUESTION = "STRUCT<name: STRING, qtype: INT, qclass: INT>"
RECORD = (
    "STRUCT<name: STRING, rrtype: INT, class: INT, ttl: BIGINT, rdlength: INT, rdata: STRING>"
)

#: One DNS message. ``answer``, ``ns`` and ``extra`` are the three record sections.
MESSAGE = (
    "STRUCT<id: INT, response: BOOLEAN, opcode: INT, authoritative: BOOLEAN, "
    "truncated: BOOLEAN, recursion_desired: BOOLEAN, recursion_available: BOOLEAN, "
    "zero: BOOLEAN, authenticated_data: BOOLEAN, checking_disabled: BOOLEAN, rcode: INT, "
    f"question: ARRAY<{QUESTION}>, answer: ARRAY<{RECORD}>, ns: ARRAY<{RECORD}>, "
    f"extra: ARRAY<{RECORD}>>"
)

#: One decoded message with its network envelope. ``seq`` is the arrival number.
DNS_RESULTS = (
    "seq BIGINT, ts TIMESTAMP, ts_ns BIGINT, ip_version INT, src_ip BINARY, src_port INT, "
    "dst_ip BINARY, dst_port INT, protocol STRING, packet_length INT, identity STRING, "
    f"version STRING, dns {MESSAGE}"
)

DNS_RESULT_COLUMNS = [
    "seq", "ts", "ts_ns", "ip_version", "src_ip", "src_port", "dst_ip", "dst_port",
    "protocol", "packet_length", "identity", "version", "dns",
]

#: The flat log, one row per question, in table order.
DNS_LOG_COLUMNS = [
    "PacketTime", "IndexTime", "Server", "IPVersion", "SrcIP", "DstIP", "Protocol", "QR",
    "OpCode", "Class", "Type", "Edns0Present", "DoBit", "FullQuery", "ResponseCode",
    "Question", "Size",
]

PACKETS = (
    "file STRING, seq BIGINT, ts TIMESTAMP, ts_ns BIGINT, caplen INT, wirelen INT, "
    "link_type INT, data BINARY"
)

LINK_ETHERNET = 1
