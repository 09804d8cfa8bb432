"""Records to text and bytes: JSON, CSV, OCSF, templates, line protocol, events.

All renderings are expressions over one result row, so they run inside the same stage as the
filters before them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namestrata.functions import codes, edns
from namestrata.functions.ip import ip_text, ip_text_of, to_number
from namestrata.functions.once import compute_once, let
from namestrata.functions.timing import rfc3339
from namestrata.functions.wire import message_bytes, proto_bytes, proto_int

# The columns of a CSV row.
CSV_COLUMNS = [
    "Year", "Month", "Day", "Hour", "Minute", "Second", "Ns", "Server", "IPVersion", "SrcIP",
    "DstIP", "Protocol", "Qr", "OpCode", "Class", "Type", "ResponseCode", "Question", "Size",
    "Edns0Present", "DoBit", "ID",
]
CSV_HEADER = ",".join(CSV_COLUMNS)

OPT = 41
DO_BIT = 0x8000


def opt_record(extra: Column) -> Column:
    """The last OPT record of the extra section, NULL without EDNS."""
    return F.try_element_at(F.filter(extra, lambda r: r["rrtype"] == OPT), F.lit(-1))


def edns_present(dns: Column) -> Column:
    return F.when(F.exists(dns["extra"], lambda r: r["rrtype"] == OPT), 1).otherwise(0)


def do_bit(dns: Column) -> Column:
    flag = opt_record(dns["extra"])["ttl"].bitwiseAND(F.lit(DO_BIT).cast("bigint"))
    return F.when(F.coalesce(flag, F.lit(0)) != 0, 1).otherwise(0)


def qr_flag(dns: Column) -> Column:
    return dns["response"].cast("int")


def protocol_number(protocol: Column) -> Column:
    return F.when(protocol == "udp", 17).otherwise(6)


def quote(text: Column) -> Column:
    """A JSON string literal."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    # What is left of {"v":"..."} ends with a quote, so only the last brace goes; NULL leaves nothing.
    return F.rtrim(F.substring(wrapped, 6, (1 << 31) - 1), F.lit("}"))


# --- JSON ------------------------------------------------------------------------------------


def _number(value: Column) -> Column:
    return value.cast("string")


def _bool(value: Column) -> Column:
    return F.when(value, "true").otherwise("false")


def _object(*pairs: tuple[str, Column]) -> Column:
    parts: list[Column] = []
    for i, (name, value) in enumerate(pairs):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def _array(values: Column) -> Column:
    """A JSON array of JSON texts; an empty one is ``null``."""
    joined = let(values, lambda v: F.when(F.size(v) > 0, F.array_join(v, ",")))
    return F.coalesce(F.concat(F.lit("["), joined, F.lit("]")), F.lit("null"))


def _record_json(r: Column) -> Column:
    header = _object(
        ("Name", quote(r["name"])), ("Rrtype", _number(r["rrtype"])),
        ("Class", _number(r["class"])), ("Ttl", _number(r["ttl"])),
        ("Rdlength", _number(r["rdlength"])),
    )
    words = F.split(r["rdata"], " ")

    def word(i):
        return F.coalesce(F.get(words, F.lit(i)), F.lit(""))

    kind = r["rrtype"]
    quoted = F.regexp_extract_all(r["rdata"], F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    body = F.when(kind == 1, _object(("Hdr", header), ("A", quote(r["rdata"]))))
    for code, name in ((28, "AAAA"), (2, "Ns"), (5, "Target"), (12, "Ptr"), (39, "Target")):
        body = body.when(kind == code, _object(("Hdr", header), (name, quote(r["rdata"]))))
    body = body.when(
        kind == 15, _object(("Hdr", header), ("Preference", word(0)), ("Mx", quote(word(1))))
    )
    body = body.when(
        kind == 33,
        _object(("Hdr", header), ("Priority", word(0)), ("Weight", word(1)), ("Port", word(2)),
                ("Target", quote(word(3)))),
    )
    body = body.when(
        kind == 6,
        _object(("Hdr", header), ("Ns", quote(word(0))), ("Mbox", quote(word(1))),
                ("Serial", word(2)), ("Refresh", word(3)), ("Retry", word(4)),
                ("Expire", word(5)), ("Minttl", word(6))),
    )
    body = body.when(
        kind.isin(16, 99), _object(("Hdr", header), ("Txt", _array(F.transform(quoted, quote))))
    )
    body = body.when(r["rdata"] == "", _object(("Hdr", header)))
    listed = F.transform(edns.options(r["rdata"]), lambda o: edns.option_json(o, quote, _object))
    body = body.when(kind == OPT, _object(("Hdr", header), ("Option", _array(listed))))
    return body.otherwise(_object(("Hdr", header), ("Rdata", quote(r["rdata"]))))


def message_json(dns: Column) -> Column:
    questions = F.transform(
        dns["question"],
        lambda q: _object(
            ("Name", quote(q["name"])), ("Qtype", _number(q["qtype"])), ("Qclass", _number(q["qclass"]))
        ),
    )
    return _object(
        ("Id", _number(dns["id"])), ("Response", _bool(dns["response"])),
        ("Opcode", _number(dns["opcode"])), ("Authoritative", _bool(dns["authoritative"])),
        ("Truncated", _bool(dns["truncated"])),
        ("RecursionDesired", _bool(dns["recursion_desired"])),
        ("RecursionAvailable", _bool(dns["recursion_available"])), ("Zero", _bool(dns["zero"])),
        ("AuthenticatedData", _bool(dns["authenticated_data"])),
        ("CheckingDisabled", _bool(dns["checking_disabled"])), ("Rcode", _number(dns["rcode"])),
        ("Question", _array(questions)), ("Answer", _array(F.transform(dns["answer"], _record_json))),
        ("Ns", _array(F.transform(dns["ns"], _record_json))),
        ("Extra", _array(F.transform(dns["extra"], _record_json))),
    )


def to_json_text() -> Column:
    """The record as JSON; ports of 0 and empty identity and version are left out."""

    def optional(name: str, value: Column, shown: Column) -> Column:
        return F.when(shown, F.concat(F.lit(f',"{name}":'), value)).otherwise("")

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c) != "", F.lit(False))

    def nonzero(c: str) -> Column:
        return F.coalesce(F.col(c) != 0, F.lit(False))

    return F.concat(
        F.lit('{"Timestamp":"'), rfc3339(F.col("ts"), F.col("ts_ns")),
        F.lit('","DNS":'), message_json(F.col("dns")),
        F.lit(',"IPVersion":'), _number(F.col("ip_version")),
        F.lit(',"SrcIP":"'), ip_text_of(F.col("src_ip")), F.lit('"'),
        optional("SrcPort", _number(F.col("src_port")), nonzero("src_port")),
        F.lit(',"DstIP":"'), ip_text_of(F.col("dst_ip")), F.lit('"'),
        optional("DstPort", _number(F.col("dst_port")), nonzero("dst_port")),
        F.lit(',"Protocol":'), quote(F.col("protocol")),
        F.lit(',"PacketLength":'), _number(F.col("packet_length")),
        optional("Identity", quote(F.col("identity")), filled("identity")),
        optional("Version", quote(F.col("version")), filled("version")),
        F.lit("}"),
    )


# --- CSV -------------------------------------------------------------------------------------


def csv_fields(server: str = "default") -> list[Column]:
    """The CSV values in column order, from the first question."""
    first, dns, ts = F.col("dns.question")[0], F.col("dns"), F.col("ts")
    return [
        F.year(ts), F.month(ts), F.day(ts), F.hour(ts), F.minute(ts), F.second(ts),
        F.pmod(F.col("ts_ns"), F.lit(1_000_000_000)), F.lit(server), F.col("ip_version"),
        to_number(F.col("src_ip")), to_number(F.col("dst_ip")),
        protocol_number(F.col("protocol")), qr_flag(dns), dns["opcode"], first["qclass"],
        first["qtype"], dns["rcode"], first["name"], F.col("packet_length"), edns_present(dns),
        do_bit(dns), dns["id"],
    ]


def to_csv_text(server: str = "default") -> Column:
    """One unquoted CSV line; NULL without a question."""
    line = F.concat_ws(",", *[c.cast("string") for c in csv_fields(server)])
    return F.when(F.size("dns.question") > 0, line)


# --- OCSF ------------------------------------------------------------------------------------

# Header flags in id order.
FLAGS = [
    ("response", "Response"), ("authoritative", "Authoritative"), ("truncated", "Truncated"),
    ("recursion_desired", "RecursionDesired"), ("recursion_available", "RecursionAvailable"),
    ("authenticated_data", "AuthenticatedData"), ("checking_disabled", "CheckingDisabled"),
]

OCSF_SCHEMA = (
    "type_uid INT, category_uid INT, class_uid INT, time BIGINT, activity_id INT, "
    "severity_id INT, query STRUCT<class: STRING, hostname: STRING, opcode: STRING, "
    "opcode_id: INT, packet_uid: INT, type: STRING>, answers ARRAY<STRUCT<class: STRING, "
    "flag_ids: ARRAY<INT>, flags: ARRAY<STRING>, packet_uid: INT, rdata: STRING, ttl: BIGINT, "
    "type: STRING>>, rcode STRING, rcode_id INT, src_endpoint STRUCT<ip: STRING, port: INT, "
    "protocol: STRING>, dst_endpoint STRUCT<ip: STRING, port: INT, protocol: STRING>, "
    "metadata STRUCT<product: STRUCT<name: STRING, vendor_name: STRING>, version: STRING>"
)


def flag_names(dns: Column) -> Column:
    named = F.array(*[F.when(dns[f], label) for f, label in FLAGS])
    return F.filter(named, lambda x: x.isNotNull())


def flag_ids(dns: Column) -> Column:
    numbered = F.array(*[F.when(dns[f], i) for i, (f, _) in enumerate(FLAGS)])
    return F.filter(numbered, lambda x: x.isNotNull())


def record_text(r: Column) -> Column:
    """Presentation form of a whole record, tab separated."""

    def shown(code: Column, names: dict[int, str], prefix: str) -> Column:
        known = F.nullif(codes.name_of(code, names), F.lit(""))
        return F.coalesce(known, F.concat(F.lit(prefix), code))

    kind = shown(r["rrtype"], codes.TYPE_NAMES, "TYPE")
    family = shown(r["class"], codes.CLASS_NAMES, "CLASS")
    return F.concat_ws("\t", r["name"], r["ttl"].cast("string"), family, kind, r["rdata"])


def ocsf_struct(vendor: str = "namestrata") -> Column:
    """The record as an OCSF DNS activity. NULL members are the ones left out of the JSON."""
    dns = F.col("dns")
    first = F.col("dns.question")[0]

    def opt(value: Column, empty) -> Column:
        return F.nullif(value, F.lit(empty))

    query = F.struct(
        codes.name_of(first["qclass"], codes.CLASS_NAMES).alias("class"),
        first["name"].alias("hostname"),
        codes.name_of(dns["opcode"], codes.OPCODE_NAMES).alias("opcode"),
        dns["opcode"].alias("opcode_id"),
        dns["id"].alias("packet_uid"),
        codes.name_of(first["qtype"], codes.TYPE_NAMES).alias("type"),
    )

    def answer(r):
        return F.struct(
            codes.name_of(r["class"], codes.CLASS_NAMES).alias("class"),
            flag_ids(dns).alias("flag_ids"),
            flag_names(dns).alias("flags"),
            dns["id"].alias("packet_uid"),
            record_text(r).alias("rdata"),
            r["ttl"].alias("ttl"),
            codes.name_of(r["rrtype"], codes.TYPE_NAMES).alias("type"),
        )

    def endpoint(ip: str, port: str) -> Column:
        return F.struct(
            ip_text_of(F.col(ip)).alias("ip"), opt(F.col(port), 0).alias("port"), F.col("protocol")
        )

    return F.struct(
        F.lit(4003).alias("type_uid"), F.lit(4).alias("category_uid"),
        F.lit(4003).alias("class_uid"), F.unix_seconds("ts").alias("time"),
        F.lit(1).alias("activity_id"), F.lit(0).alias("severity_id"),
        F.when(F.size("dns.question") > 0, query).alias("query"),
        F.when(F.size("dns.answer") > 0, F.transform("dns.answer", answer)).alias("answers"),
        opt(codes.name_of(dns["rcode"], codes.RCODE_NAMES), "").alias("rcode"),
        opt(dns["rcode"], 0).alias("rcode_id"),
        endpoint("src_ip", "src_port").alias("src_endpoint"),
        endpoint("dst_ip", "dst_port").alias("dst_endpoint"),
        F.struct(
            F.struct(F.lit("dns").alias("name"), F.lit(vendor).alias("vendor_name")).alias("product"),
            F.lit("1.0.0").alias("version"),
        ).alias("metadata"),
    )


def to_ocsf_text(vendor: str = "namestrata") -> Column:
    return F.to_json(ocsf_struct(vendor))


def parse_ocsf(lines: DataFrame, column: str = "value") -> DataFrame:
    """OCSF lines back to messages (``dns``): the first question, answers and rcode only.

    Lines that are no JSON are dropped.
    """
    parsed = lines.withColumn("__o", F.from_json(column, OCSF_SCHEMA)).filter(
        F.col("__o.type_uid").isNotNull()
    )
    o = F.col("__o")

    def record(a):
        parts = F.split(a["rdata"], "\t")
        return F.struct(
            F.get(parts, F.lit(0)).alias("name"),
            codes.code_of(F.get(parts, F.lit(3)), codes.TYPE_NAMES).alias("rrtype"),
            codes.code_of(F.get(parts, F.lit(2)), codes.CLASS_NAMES).alias("class"),
            F.get(parts, F.lit(1)).try_cast("bigint").alias("ttl"),
            F.lit(None).cast("int").alias("rdlength"),
            F.get(parts, F.lit(4)).alias("rdata"),
        )

    question = F.struct(
        F.col("__o.query.hostname").alias("name"),
        codes.code_of(F.col("__o.query.type"), codes.TYPE_NAMES).alias("qtype"),
        codes.code_of(F.col("__o.query.class"), codes.CLASS_NAMES).alias("qclass"),
    )
    empty_q = F.expr("CAST(array() AS ARRAY<STRUCT<name: STRING, qtype: INT, qclass: INT>>)")
    dns = F.struct(
        F.coalesce(o["rcode_id"], F.lit(0)).alias("rcode"),
        F.when(o["query"].isNotNull(), F.array(question)).otherwise(empty_q).alias("question"),
        F.coalesce(F.transform(o["answers"], record), F.array()).alias("answer"),
    )
    return parsed.withColumn("dns", dns).drop("__o")


# --- templates -------------------------------------------------------------------------------

_FIELD = re.compile(r"\{\{\s*(.*?)\s*\}\}")
_INDEXED = re.compile(r"^\(index \.([\w.]+) (\d+)\)((?:\.\w+)*)$")

# Names a template uses for record members.
PATHS = {
    "Timestamp": "ts", "IPVersion": "ip_version", "SrcIP": "src_ip", "SrcPort": "src_port",
    "DstIP": "dst_ip", "DstPort": "dst_port", "Protocol": "protocol",
    "PacketLength": "packet_length", "Identity": "identity", "Version": "version", "DNS": "dns",
    "Id": "id", "Response": "response", "Opcode": "opcode", "Authoritative": "authoritative",
    "Truncated": "truncated", "RecursionDesired": "recursion_desired",
    "RecursionAvailable": "recursion_available", "Zero": "zero",
    "AuthenticatedData": "authenticated_data", "CheckingDisabled": "checking_disabled",
    "Rcode": "rcode", "Question": "question", "Answer": "answer", "Ns": "ns", "Extra": "extra",
    "Name": "name", "Qtype": "qtype", "Qclass": "qclass", "Rrtype": "rrtype", "Class": "class",
    "Ttl": "ttl", "Rdlength": "rdlength",
}


def _member(path: str) -> Column:
    names = [p for p in path.split(".") if p and p != "Hdr"]
    unknown = [n for n in names if n not in PATHS]
    if unknown or not names:
        raise ValueError(f"unknown template member {path!r}")
    return F.col(".".join(PATHS[n] for n in names))


def _template_value(text: str) -> Column:
    indexed = _INDEXED.match(text)
    if indexed:
        value = F.get(_member(indexed[1]), F.lit(int(indexed[2])))
        for name in [n for n in indexed[3].split(".") if n and n != "Hdr"]:
            if name not in PATHS:
                raise ValueError(f"unknown template member {name!r}")
            value = value[PATHS[name]]
        return value.cast("string")
    if not text.startswith("."):
        raise ValueError(f"unsupported template action {text!r}")
    name = text[1:]
    if name == "Timestamp":
        stamp = F.regexp_replace(rfc3339(F.col("ts"), F.col("ts_ns")), "T", " ")
        return F.regexp_replace(stamp, "Z$", " +0000 UTC")
    if name in ("SrcIP", "DstIP"):
        return ip_text(_member(name))
    if name in ("SrcPort", "DstPort"):
        return F.coalesce(_member(name), F.lit(0)).cast("string")
    if name in ("Identity", "Version"):
        return F.coalesce(_member(name), F.lit(""))
    return _member(name).cast("string")


def to_template_text(template: str) -> Column:
    """Render ``{{.Path}}`` and ``{{(index .Path n).Name}}``; NULL where an index is missing."""
    parts, at = [], 0
    for found in _FIELD.finditer(template):
        parts += [F.lit(template[at : found.start()]), _template_value(found[1])]
        at = found.end()
    return F.concat(*parts, F.lit(template[at:]))


# --- other frames ----------------------------------------------------------------------------


def to_event_bytes() -> Column:
    """The record as a serialized event: index fields, then the packed message."""
    dns, first = F.col("dns"), F.get(F.col("dns.question"), F.lit(0))

    def text(c: Column) -> Column:
        return F.hex(F.encode(c, "UTF-8"))

    return F.unhex(
        F.concat(
            proto_int(1, F.col("ts_ns"), 9), proto_bytes(2, F.hex("src_ip")),
            proto_bytes(3, F.hex("dst_ip")), proto_int(4, F.col("src_port"), 3),
            proto_int(5, F.col("dst_port"), 3), proto_int(6, F.col("ip_version"), 1),
            proto_bytes(7, text(F.col("protocol"))), proto_int(8, F.col("packet_length"), 3),
            proto_bytes(9, text(F.col("identity"))), proto_bytes(10, text(F.col("version"))),
            proto_bytes(11, text(first["name"])), proto_int(12, first["qtype"], 3),
            proto_int(13, dns["rcode"], 2), proto_int(14, dns["response"].cast("int"), 1),
            proto_bytes(15, F.hex(message_bytes(dns))),
        )
    )


def to_packed_bytes() -> Column:
    """The packed form of a record: its message in wire form."""
    return message_bytes(F.col("dns"))


# --- dispatch --------------------------------------------------------------------------------

Format = Callable[..., Column]
FORMATS: dict[str, Format] = {
    "json": lambda **o: to_json_text(),
    "json-ocsf": lambda **o: to_ocsf_text(o.get("vendor", "namestrata")),
    "csv": lambda **o: to_csv_text(o.get("server", "default")),
    "csv_no_header": lambda **o: to_csv_text(o.get("server", "default")),
    "gotemplate": lambda **o: to_template_text(o["template"]),
    "gob": lambda **o: to_packed_bytes(),
}
FORMATS["template"], FORMATS["packed"] = FORMATS["gotemplate"], FORMATS["gob"]


def register_format(name: str, render: Format) -> None:
    """Add an output format: a function of options that returns the value column."""
    FORMATS[name] = render


def format_column(name: str, **options) -> Column:
    if name not in FORMATS:
        raise ValueError(f"{name} is not a valid output format")
    return FORMATS[name](**options)


def format_header(name: str) -> str:
    """Text to write before the first record."""
    return CSV_HEADER if name == "csv" else ""


def render(results: DataFrame, name: str, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Records in a named format, one ``value`` each; records without a rendering drop out."""
    # The filter would be pushed below a plain projection and render every record a second time.
    shown = compute_once(results, {"value": format_column(name, **options)})
    return shown.select(*keep, "value").filter("value IS NOT NULL")
