"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namestrata.functions import codes, formats
from namestrata.functions.binary import hex_uint
from namestrata.functions.ip import ip_bytes, ip_text, ip_text_of, mask_ip, to_16, to_number
from namestrata.functions.once import compute_once
from namestrata.operators import (
    domain_filter,
    headers,
    messages,
    metrics,
    reports,
    retention,
    rollups,
    rows,
    sampling,
)
from namestrata.operators.counters import Counters
from namestrata.operators.reassembly import reassemble_fragments, tcp_messages
from namestrata.plans import traffic
from namestrata.plans.capture import packets_to_results
from namestrata.session import cut_lineage, shared_dir
from namestrata.sinks import frames, tables
from namestrata.sinks.delivery import deliver
from namestrata.sources import capture_source, captures, protobuf
from namestrata.sources.domain_lists import domain_list_from, parse_domain_list
from namestrata.streaming import jobs
from namestrata.streaming.batches import batches_stream, run_until_flushed
from namestrata.streaming.reassembly import reassemble_fragments_stream, tcp_messages_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2024-01-31"
SKIP_LINES = ["example.com.,suffix", "view,prefix", "LOGIN1.sample.org."]
ALLOW_LINES = [
    "purchase,prefix", "purchase1,fqdn", "sample.org.,suffix", "error1,prefix", "error1,fqdn", "a,b,c",
]


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


# --- rollups ---------------------------------------------------------------------------------

ROLLUP_IDS = {
    "R1_domain_count": "domain_count", "R2_domain_unique": "domain_unique", "R3_protocol": "protocol",
    "R4_general": "general", "R5_edns": "edns", "R6_opcode": "opcode", "R7_type": "type",
    "R8_class": "class", "R9_response": "response", "R10_srcip": "srcip", "R11_dstip": "dstip",
}


def _rollup_query(name: str, grain: str | None) -> Query:
    def run(spark, sf_dir):
        return rollups.rollup(traffic.dns_log(spark, sf_dir), name, grain)

    return run


for _key, _name in ROLLUP_IDS.items():
    QUERIES[_key] = _rollup_query(_name, None)
    QUERIES[f"{_key}_by_day"] = _rollup_query(_name, "day")


# The replicated layout stores whole seconds and groups on what it stores.
for _key in ("R2_domain_unique", "R3_protocol", "R4_general", "R5_edns", "R6_opcode"):
    QUERIES[f"R12_stored_{_key}"] = _rollup_query(ROLLUP_IDS[_key], "second")


@query("R13_merge_states")
def merge_states(spark, sf_dir):
    """Partial states by millisecond, merged to days."""
    parts = rollups.partial_rollup(traffic.dns_log(spark, sf_dir), "general")
    return rollups.finalize(rollups.merge_rollup(parts, "general", "day"), "general")


@query("R13_merge_counts")
def merge_counts(spark, sf_dir):
    parts = rollups.partial_rollup(traffic.dns_log(spark, sf_dir), "type")
    return rollups.finalize(rollups.merge_rollup(parts, "type", "day"), "type")


@query("R13_merge_sketches")
def merge_sketches(spark, sf_dir):
    """Distinct names per day and server from merged sketches, with the exact value beside it."""
    log = traffic.dns_log(spark, sf_dir)
    parts = rollups.partial_rollup(log, "domain_unique", "hour")
    estimate = rollups.finalize(rollups.merge_rollup(parts, "domain_unique", "day"), "domain_unique")
    exact = rollups.rollup(log, "domain_unique", "day").withColumnRenamed("UniqueDnsCount", "exact")
    near = F.abs(F.col("UniqueDnsCount") - F.col("exact")) <= F.greatest(F.lit(2.0), F.col("exact") * 0.1)
    return estimate.join(exact, ["DnsDate", "timestamp", "Server"]).select(
        "DnsDate", "Server", "exact", near.alias("within_tenth")
    )


# --- reports ---------------------------------------------------------------------------------


@query("A1_request_timeline")
def request_timeline(spark, sf_dir):
    return reports.request_timeline(traffic.dns_log(spark, sf_dir))


def _domain_count(spark, sf_dir):
    return rollups.rollup(traffic.dns_log(spark, sf_dir), "domain_count")


@query("A2_distinct_domains")
def distinct_domains(spark, sf_dir):
    return reports.distinct_domains(_domain_count(spark, sf_dir), AS_OF, 72)


@query("A3_count_distinct_domains")
def count_distinct_domains(spark, sf_dir):
    return reports.count_distinct_domains(_domain_count(spark, sf_dir), AS_OF, 72)


@query("A4_top_domains")
def top_domains(spark, sf_dir):
    return reports.top_domains(_domain_count(spark, sf_dir), 20)


@query("J1_new_domains")
def new_domains(spark, sf_dir):
    return reports.new_domains(traffic.dns_log(spark, sf_dir), AS_OF, recent_days=2)


def _label_query(which: str) -> Query:
    column = codes.DICTIONARIES[which][0]

    def run(spark, sf_dir):
        log = codes.with_label(traffic.dns_log(spark, sf_dir), which)
        return log.groupBy(column, f"{column}Name").agg(F.count(F.lit(1)).alias("c"))

    return run


for _key, _which in {
    "J2_type_names": "type", "J3_class_names": "class", "J4_opcode_names": "opcode",
    "J5_response_names": "response",
}.items():
    QUERIES[_key] = _label_query(_which)


@query("S6_dictionary_rows")
def dictionary_rows(spark, sf_dir):
    """The types that occur in the log, with their dictionary entry if there is one."""
    seen = traffic.dns_log(spark, sf_dir).select(F.col("Type").cast("bigint").alias("Id")).distinct()
    return seen.join(F.broadcast(codes.dictionary(spark, "type")), "Id", "left")


@query("A5_counters")
def counters(spark, sf_dir):
    """Sent and skipped questions of an output with a skip list."""
    log = traffic.dns_log(spark, sf_dir)
    plain = domain_filter.short_list(domain_list_from(spark, SKIP_LINES))
    hit = domain_filter.known(plain.matches(F.col("Question")))
    return log.agg(
        F.count(F.lit(1)).alias("dispatched"), F.count_if(~hit).alias("sent"), F.count_if(hit).alias("skipped")
    )


@query("A5_pipeline_counters")
def pipeline_counters(spark, sf_dir):
    """Every counter of the capture plan and its outputs, from the jobs that do the work.

    Every seventh packet comes twice, every 29th has no readable header; one output of four fails.
    """
    packets = traffic.udp_packets(spark, sf_dir)
    junk = F.concat(F.unhex(F.lit("FF" * 14)), "data")
    packets = packets.withColumn("data", F.when(F.col("seq") % 29 == 0, junk).otherwise(F.col("data")))
    again = F.explode(F.when(F.col("seq") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    packets = packets.withColumn("again", again).withColumn("seq", F.col("seq") * 2 + F.col("again")).drop("again")
    seen = Counters()
    results = packets_to_results(cut_lineage(packets, "capture"), ratio="1:4", dedup_seconds=60, counters=seen)
    folder = shared_dir(spark, "outputs")
    tables.register_sink("unreachable", _unreachable)
    outputs = [
        ("parquet", 2, {"path": f"{folder}/rows"}), ("log", 1, {"path": f"{folder}/log"}),
        ("frames", 3, {"path": f"{folder}/syslog", "name": "syslog", "label": "syslog"}), ("unreachable", 2, {}),
    ]
    skip, allow = domain_list_from(spark, SKIP_LINES), domain_list_from(spark, ALLOW_LINES)
    deliver(cut_lineage(results, "results"), outputs, skip, allow, seen)
    return seen.row(spark)


def _unreachable(df, options):
    raise ConnectionError("no such host")


@query("A6_loss_percent")
def loss(spark, sf_dir):
    log = traffic.dns_log(spark, sf_dir)
    counts = log.groupBy("Server").agg(
        F.count(F.lit(1)).alias("captured"), F.count_if(F.col("ResponseCode") == 3).alias("dropped")
    )
    percent = metrics.loss_percent(F.col("dropped"), F.col("captured"))
    return counts.withColumn("loss_percent", F.round(percent, 6))


@query("A7_metrics_text")
def metrics_text(spark, sf_dir):
    counts = counters(spark, sf_dir)
    return metrics.metrics_json(counts).unionByName(metrics.metrics_pairs(counts))


# --- filters ---------------------------------------------------------------------------------


@query("S5_domain_list")
def domain_list(spark, sf_dir):
    """Lines made from the names of the log, normalised."""
    return parse_domain_list(_list_lines(spark, sf_dir)).select("role", "pattern", "active")


def _list_lines(spark, sf_dir) -> DataFrame:
    """A long list: every fifth name of the log as some kind of pattern, with repeats."""
    log = traffic.dns_log(spark, sf_dir).filter("seq % 5 = 0")
    kind = (
        F.when(F.col("seq") % 15 == 0, "prefix").when(F.col("seq") % 15 == 5, "suffix").otherwise("fqdn")
    )
    start, length = (F.col("seq") % 3).cast("int"), (F.col("seq") % 5 + 10).cast("int")
    pattern = (
        F.when(kind == "prefix", F.substring(F.col("Question"), F.lit(1), length))
        .when(kind == "suffix", F.substring(F.col("Question"), start + 3, F.lit(64)))
        .otherwise(F.col("Question"))
    )
    line = F.concat(pattern, F.lit(","), F.when(F.col("seq") % 35 == 0, "odd").otherwise(kind))
    return log.select(F.col("seq").alias("line_no"), line.alias("line"))


def _filter_query(mode: int) -> Query:
    def run(spark, sf_dir):
        skip, allow = domain_list_from(spark, SKIP_LINES), domain_list_from(spark, ALLOW_LINES)
        log = traffic.dns_log(spark, sf_dir)
        return domain_filter.filter_domains(log, mode, skip, allow).select("seq", "Question")

    return run


QUERIES["F7_output_all"] = _filter_query(1)
QUERIES["F7_output_none"] = _filter_query(0)
QUERIES["F8_skip_list"] = _filter_query(2)
QUERIES["F9_allow_list"] = _filter_query(3)
QUERIES["F10_skip_and_allow"] = _filter_query(4)


@query("F9_allow_empty_list")
def allow_empty(spark, sf_dir):
    log = traffic.dns_log(spark, sf_dir)
    return domain_filter.filter_domains(log, 3).select("seq", "Question")


@query("J6_long_list")
def long_list(spark, sf_dir):
    """The skip filter with a list as long as the log, by equi-joins on distinct names."""
    log = traffic.dns_log(spark, sf_dir)
    patterns = parse_domain_list(_list_lines(spark, sf_dir))
    return domain_filter.filter_domains(log, 2, patterns, short=0).select("seq", "Question")


@query("F11_longest_match")
def longest_match(spark, sf_dir):
    """Names that a list with shadowed patterns lets through."""
    lines = [
        "pur,prefix", "purchase1,prefix", "purchase1,fqdn", "org.,suffix", "e.org.,suffix",
        ".gro.e,fqdn", "1.Example.com.,suffix",
    ]
    log = traffic.dns_log(spark, sf_dir)
    return domain_filter.filter_domains(log, 3, allow=domain_list_from(spark, lines)).select("seq", "Question")


@query("F12_per_question")
def per_question_filter(spark, sf_dir):
    questions = rows.explode_questions(traffic.results(spark, sf_dir))
    skip = domain_list_from(spark, ["alt.,prefix", *SKIP_LINES])
    kept = domain_filter.filter_domains(questions, 2, skip, column="q.name")
    return kept.select("seq", F.col("q.name").alias("name"))


@query("F13_per_message")
def per_message_filter(spark, sf_dir):
    skip = domain_list_from(spark, ["alt.,prefix", *SKIP_LINES])
    return domain_filter.filter_messages(traffic.results(spark, sf_dir), 2, skip).select("seq")


def _two_captures(spark, sf_dir):
    """Records of two captures whose numbers restart, so ``seq`` alone tells no two apart."""
    return traffic.results(spark, sf_dir).withColumn("seq", F.expr("seq div 2"))


def _counted(results):
    return results.groupBy("seq", F.col("dns.id").alias("id")).agg(F.count(F.lit(1)).alias("c"))


@query("F13_long_list")
def per_message_long_list(spark, sf_dir):
    """The per-message filter by joins; of two records with one number either may go."""
    skip = domain_list_from(spark, ["alt.,prefix", *SKIP_LINES])
    return _counted(domain_filter.filter_messages(_two_captures(spark, sf_dir), 2, skip, short=0))


@query("F12_long_list")
def per_question_long_list(spark, sf_dir):
    questions = rows.explode_questions(_two_captures(spark, sf_dir))
    skip = domain_list_from(spark, ["alt.,prefix", *SKIP_LINES])
    kept = domain_filter.filter_domains(questions.withColumn("name", F.col("q.name")), 2, skip, column="name", short=0)
    return kept.select("seq", "name")


@query("F14_event_output_unfiltered")
def unfiltered(spark, sf_dir):
    """The event output counts skipped questions but publishes every message."""
    return frames.nats_events(traffic.results(spark, sf_dir)).select("seq")


@query("F15_bulk_output_unfiltered")
def bulk_unfiltered(spark, sf_dir):
    return frames.zinc_bulk(traffic.results(spark, sf_dir)).select("seq")


@query("F16_with_questions")
def with_questions(spark, sf_dir):
    return domain_filter.with_questions(traffic.results(spark, sf_dir)).select("seq")


@query("F18_queries_only")
def queries_only(spark, sf_dir):
    log = traffic.dns_log(spark, sf_dir).filter(rollups.QUERIES)
    return log.groupBy("Server").agg(F.count(F.lit(1)).alias("c"))


@query("F19_retention")
def retained(spark, sf_dir):
    log = traffic.dns_log(spark, sf_dir).withColumn("dns_date", F.to_date("PacketTime"))
    return retention.within_retention(log, "dns_date", "2024-02-14", 30).select("seq")


@query("F20_partition_cleanup")
def cleaned(spark, sf_dir):
    """A written log whose expired day folders were dropped."""
    path = shared_dir(spark, "log")
    log = traffic.dns_log(spark, sf_dir)
    tables.write_log(log, path)
    retention.drop_expired_partitions(spark, path, "2024-02-14", 30)
    return tables.read_log(spark, path).select("seq", "dns_date")


@query("F21_key_sample")
def sampled_by_key(spark, sf_dir):
    """The sample by type number; hash samples depend on the engine's hash."""
    log = traffic.dns_log(spark, sf_dir)
    return retention.modulo_sample(log, "Type", 1, 3).select("seq", "Type")


@query("F21_hash_sample")
def sampled_by_hash(spark, sf_dir):
    log = retention.key_sample(traffic.dns_log(spark, sf_dir), 1, 4, "Question")
    return log.groupBy("Question").agg(F.count(F.lit(1)).alias("c"))


@query("F22_last_day")
def last_day(spark, sf_dir):
    log = traffic.dns_log(spark, sf_dir)
    return reports.since(log, "PacketTime", "2024-01-20", 24).select("seq", "PacketTime")


@query("suffix_search")
def suffix_search(spark, sf_dir):
    path = shared_dir(spark, "log")
    tables.write_log(traffic.dns_log(spark, sf_dir), path)
    return domain_filter.suffix_filter(tables.read_log(spark, path), "sample.org.").select("seq")


# --- sampling, copies, limits ----------------------------------------------------------------


def _sample_query(ratio: str, mode: str) -> Query:
    def run(spark, sf_dir):
        log = traffic.dns_log(spark, sf_dir)
        return sampling.sample_records(log, ratio, mode, by=("Server",)).select("seq", "Server")

    return run


QUERIES["F4_sample_packets"] = _sample_query("2:7", "reference_packet")
QUERIES["F5_sample_dnstap"] = _sample_query("3:10", "reference_dnstap")
QUERIES["F4_sample_exact"] = _sample_query("1:10", "exact")


def _copied(spark, sf_dir):
    """Packets of two captures, most of them copies within their capture and day; the same
    payloads recur in the other capture and on other days."""
    log = traffic.dns_log(spark, sf_dir)
    return log.select(
        "seq", F.concat(F.lit("capture"), F.col("seq") % 2).alias("file"),
        F.col("PacketTime").cast("timestamp").alias("ts"), F.expr(_COPIED_DATA).alias("data"),
    )


#: Payloads with few values.
_COPIED_DATA = "cast(concat_ws('|', Type, Protocol, left(Question, 1)) AS binary)"


@query("F6_drop_copies")
def copies(spark, sf_dir):
    return sampling.drop_copies(_copied(spark, sf_dir), 86400, by=("file",)).select("seq")


@query("F6_drop_copies_exact_hash")
def copies_exact(spark, sf_dir):
    kept = sampling.drop_copies(_copied(spark, sf_dir), 86400, by=("file",), exact_hash=True)
    return kept.select("seq")


@query("F6_sample_then_drop_copies")
def sampled_copies(spark, sf_dir):
    kept = sampling.sample_then_drop_copies(
        _copied(spark, sf_dir), "1:4", seconds=86400, by=("file",)
    )
    return kept.select("seq")


@query("fnv1a64")
def fnv(spark, sf_dir):
    """The FNV-1a hash of names; names and hashes are one to one."""
    log = traffic.dns_log(spark, sf_dir)
    hashed = log.select("Question", sampling.fnv1a64(F.col("Question").cast("binary")).alias("h"))
    return hashed.agg(
        F.count_distinct("Question").alias("names"), F.count_distinct("h").alias("hashes")
    )


@query("F17_packet_limit")
def packet_limit(spark, sf_dir):
    log = traffic.dns_log(spark, sf_dir).withColumn("flush", F.to_date("PacketTime"))
    return sampling.limit_per_flush(log, 25, "flush").select("seq", "flush")


# --- projections and formats -----------------------------------------------------------------


@query("P1_explode_questions")
def exploded(spark, sf_dir):
    q = rows.explode_questions(traffic.results(spark, sf_dir))
    return q.select("seq", F.col("q.name").alias("name"), F.col("q.qtype").alias("qtype"))


@query("P2_dns_log_rows")
def log_rows(spark, sf_dir):
    """Log rows from results; addresses as text, without the time of writing."""
    flat = rows.dns_log_rows(traffic.results(spark, sf_dir), "resolver")
    shown = flat.drop("IndexTime", "FullQuery").withColumns(
        {c: ip_text(F.col(c)) for c in ("SrcIP", "DstIP")}
    )
    return shown.withColumn("PacketTime", F.col("PacketTime").cast("timestamp_ntz"))


@query("P3_server_identity")
def identity(spark, sf_dir):
    flat = rows.dns_log_rows(traffic.results(spark, sf_dir), use_identity=True)
    return flat.groupBy("Server").agg(F.count(F.lit(1)).alias("c"))


@query("P4_P5_flags")
def flags(spark, sf_dir):
    dns = F.col("dns")
    return traffic.results(spark, sf_dir).select(
        "seq", formats.edns_present(dns).alias("edns"), formats.do_bit(dns).alias("do_bit"),
        formats.qr_flag(dns).alias("qr"),
    )


@query("P6_mask")
def masked(spark, sf_dir):
    ip = mask_ip(F.col("src_ip"), 24, 112)
    return traffic.results(spark, sf_dir).select("seq", ip_text(ip).alias("net"))


@query("P7_mapped")
def mapped(spark, sf_dir):
    return traffic.results(spark, sf_dir).select("seq", F.hex(to_16(F.col("src_ip"))).alias("ip16"))


@query("P8_ip_number")
def ip_number(spark, sf_dir):
    number = to_number(F.col("src_ip")).cast("string")
    return traffic.results(spark, sf_dir).select("seq", number.alias("number"))


@query("ip_text_round_trip")
def ip_round_trip(spark, sf_dir):
    log = traffic.dns_log(spark, sf_dir)
    return log.select("seq", ip_text(ip_bytes(F.col("SrcIP"))).alias("SrcIP"))


@query("P9_protocol_number")
def protocol_no(spark, sf_dir):
    log = traffic.dns_log(spark, sf_dir)
    return log.groupBy(formats.protocol_number(F.col("Protocol")).alias("number")).agg(
        F.count(F.lit(1)).alias("c")
    )


@query("P10_P11_index_time_full_query")
def full_query(spark, sf_dir):
    flat = rows.dns_log_rows(traffic.results(spark, sf_dir), save_full_query=True)
    return flat.select(
        F.get_json_object("FullQuery", "$.DNS.Id").cast("int").alias("id"),
        "Question", F.col("IndexTime").isNotNull().alias("stamped"),
    )


def _render_query(fmt: str, **options) -> Query:
    def run(spark, sf_dir):
        return formats.render(traffic.results(spark, sf_dir), fmt, keep=("seq",), **options)

    return run


QUERIES["P12_json"] = _render_query("json")


@query("P12_edns_options")
def edns_options(spark, sf_dir):
    """Messages with two to four EDNS options, packed, decoded again and written as JSON."""
    e = F.col("seq")
    listed = F.concat(
        F.lit("0008000600011000" + "0A"), hex_uint(e % 250, 1), F.lit("000A0008"), hex_uint(e, 8),
        F.when(e % 2 == 0, "000300046E732D31").otherwise(""), F.when(e % 3 == 0, "FDE90002BEEF").otherwise(""),
    )
    size = F.expr("length(listed) div 2").cast("int")
    data = F.concat(F.lit("\\# "), size.cast("string"), F.lit(" "), F.col("listed"))
    extra = F.transform("dns.extra", lambda r: r.withField("rdlength", size).withField("rdata", data))
    told = traffic.results(spark, sf_dir).withColumn("listed", listed)
    told = compute_once(told, {"dns": F.col("dns").withField("extra", extra)}).drop("listed")
    packed = messages.pack(told, "payload").drop("dns")
    return formats.render(messages.unpack(packed), "json", keep=("seq",))


QUERIES["P13_csv"] = _render_query("csv", server="resolver")
QUERIES["P15_template"] = _render_query(
    "gotemplate", template='id={{.DNS.Id}} src={{.SrcIP}} question={{(index .DNS.Question 0).Name}}'
)
QUERIES["P16_ocsf"] = _render_query("json-ocsf")


@query("P14_csv_header")
def csv_header(spark, sf_dir):
    """The header's columns beside how many lines fill each of them."""
    lines = formats.render(traffic.results(spark, sf_dir), "csv_no_header")
    names = F.lit(formats.format_header("csv"))
    pairs = F.arrays_zip(F.split(names, ",").alias("name"), F.split("value", ",").alias("text"))
    cells = lines.select(F.posexplode(pairs).alias("pos", "cell"))
    return cells.groupBy("pos", F.col("cell.name").alias("name")).agg(
        F.count_if(F.col("cell.text") != "").alias("filled")
    )


@query("P17_header_flags")
def header_flags(spark, sf_dir):
    dns = F.col("dns")
    return traffic.results(spark, sf_dir).select(
        "seq", F.array_join(formats.flag_names(dns), ",").alias("flags"),
        F.array_join(F.transform(formats.flag_ids(dns), lambda x: x.cast("string")), ",").alias("ids"),
    )


@query("P18_protocol_names")
def protocol_names(spark, sf_dir):
    log = traffic.dns_log(spark, sf_dir)
    named = log.select(
        codes.name_of(F.col("Type"), codes.TYPE_NAMES).alias("type"),
        codes.name_of(F.col("Class"), codes.CLASS_NAMES).alias("class"),
        codes.name_of(F.col("OpCode"), codes.OPCODE_NAMES).alias("opcode"),
        codes.name_of(F.col("ResponseCode"), codes.RCODE_NAMES).alias("rcode"),
    )
    return named.groupBy("type", "class", "opcode", "rcode").agg(F.count(F.lit(1)).alias("c"))


@query("P21_pack_header")
def packed_header(spark, sf_dir):
    """The first 12 bytes of packed messages: id, flags and counts."""
    packed = messages.pack(traffic.results(spark, sf_dir))
    return packed.select("seq", F.hex(F.substring("dns_wire", 1, 12)).alias("header"))


def _unpacked(spark, sf_dir):
    wired = traffic.wired(traffic.results(spark, sf_dir)).select("seq", "wire")
    return messages.unpack(wired, "wire")


@query("D4_unpack_questions")
def unpack_questions(spark, sf_dir):
    q = F.explode("dns.question").alias("q")
    return _unpacked(spark, sf_dir).select("seq", q).select("seq", "q.name", "q.qtype", "q.qclass")


@query("D4_unpack_answers")
def unpack_answers(spark, sf_dir):
    r = F.explode("dns.answer").alias("r")
    return _unpacked(spark, sf_dir).select("seq", r).select("seq", "r.name", "r.rrtype", "r.ttl", "r.rdata")


@query("D4_unpack_flags")
def unpack_flags(spark, sf_dir):
    d = F.col("dns")
    names = ["response", "authoritative", "truncated", "recursion_desired", "recursion_available",
             "authenticated_data", "checking_disabled"]
    return _unpacked(spark, sf_dir).select(
        "seq", d["id"].alias("id"), d["opcode"].alias("opcode"), d["rcode"].alias("rcode"),
        F.array_join(F.array(*[d[n].cast("int").cast("string") for n in names]), "").alias("bits"),
        F.size(d["ns"]).alias("ns"), formats.edns_present(d).alias("edns"),
        formats.do_bit(d).alias("do_bit"),
    )


@query("P19_packed_records")
def packed_records(spark, sf_dir):
    """Records with their message packed, read back."""
    packed = formats.render(traffic.results(spark, sf_dir), "packed", keep=("seq",))
    back = messages.unpack(packed, "value")
    return back.select("seq", F.col("dns.id").alias("id"), F.size("dns.question").alias("questions"))


@query("P22_parquet_row")
def parquet_row(spark, sf_dir):
    flat = rows.parquet_rows(traffic.results(spark, sf_dir))
    shown = flat.withColumns({c: ip_text(F.col(c)) for c in ("src_ip", "dst_ip")})
    return shown.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("P23_postgres_row")
def postgres_row(spark, sf_dir):
    flat = rows.postgres_rows(traffic.results(spark, sf_dir), "resolver").drop("IndexTime", "FullQuery")
    return flat.withColumn("PacketTime", F.col("PacketTime").cast("timestamp_ntz"))


@query("P24_influx_points")
def influx(spark, sf_dir):
    return frames.influx_points(traffic.results(spark, sf_dir), "resolver").select("seq", "value")


@query("P25_elastic_documents")
def elastic(spark, sf_dir):
    docs = frames.elastic_documents(traffic.results(spark, sf_dir))
    return docs.select("seq", "name", F.get_json_object("value", "$.DNS.Id").cast("int").alias("id"))


@query("P26_zinc_bulk")
def zinc(spark, sf_dir):
    bulk = frames.zinc_bulk(traffic.results(spark, sf_dir), "dnsx")
    lines = F.split("value", "\n")
    return bulk.select(
        "seq", F.get(lines, F.lit(0)).alias("head"), F.size(lines).alias("lines"),
        F.get_json_object(F.get(lines, F.lit(1)), "$.PacketLength").cast("int").alias("size"),
    )


@query("P27_splunk_events")
def splunk(spark, sf_dir):
    events = frames.splunk_events(traffic.results(spark, sf_dir), "src", "st", "ix")
    return events.select(
        "seq", "name", F.get_json_object("value", "$.time").cast("bigint").alias("time"),
        F.get_json_object("value", "$.index").alias("index"),
        F.get_json_object(F.get_json_object("value", "$.event"), "$.IPVersion").cast("int").alias("v"),
    )


@query("P28_sentinel_batches")
def sentinel(spark, sf_dir):
    batches = frames.sentinel_batches(traffic.results(spark, sf_dir), 64)
    ids = F.from_json("value", "array<struct<PacketLength int>>")
    total = F.aggregate(ids, F.lit(0), lambda acc, x: acc + x["PacketLength"])
    return batches.select("batch", "rows", F.size(ids).alias("parsed"), total.alias("size"))


@query("P29_victoria_batches")
def victoria(spark, sf_dir):
    batches = frames.victoria_batches(traffic.results(spark, sf_dir), 50)
    lines = F.split("value", "\n")
    first = F.get_json_object(F.get(lines, F.lit(0)), "$.query.hostname")
    return batches.select("batch", "rows", F.size(lines).alias("lines"), first.alias("first"))


@query("P30_syslog_lines")
def syslog(spark, sf_dir):
    lines = frames.syslog_lines(traffic.results(spark, sf_dir), "resolver")
    return lines.select("seq", "name", F.substring("value", 1, 13).alias("head"))


@query("P31_kafka_records")
def kafka(spark, sf_dir):
    records = frames.kafka_records(traffic.results(spark, sf_dir))
    checked = records.select(
        F.octet_length("key").alias("key_size"),
        F.get_json_object(F.col("value").cast("string"), "$.DNS.Id").cast("int").alias("id"),
    )
    return checked.groupBy("key_size").agg(
        F.count(F.lit(1)).alias("c"), F.sum("id").alias("ids")
    )


@query("P32_storage_key")
def storage_key(spark, sf_dir):
    return rows.with_storage_key(traffic.dns_log(spark, sf_dir)).select("seq", "hour", "rq")


@query("P33_question_hash")
def question_hash(spark, sf_dir):
    log = traffic.dns_log(spark, sf_dir).select("Question", rows.question_hash().alias("QH"))
    return log.agg(F.count_distinct("Question").alias("names"), F.count_distinct("QH").alias("hashes"))


@query("P34_formats")
def all_formats(spark, sf_dir):
    """How many records each format renders."""
    results = traffic.results(spark, sf_dir)
    names = ["json", "json-ocsf", "csv", "csv_no_header", "gotemplate", "gob"]
    shown = results.select(
        *[formats.format_column(n, template="{{.Protocol}}").cast("binary").alias(n) for n in names]
    )
    counts = shown.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in names])
    return counts.unpivot([], [f"`{n}`" for n in names], "format", "records")


@query("S8_ocsf_scan")
def ocsf_scan(spark, sf_dir):
    lines = formats.render(traffic.results(spark, sf_dir), "json-ocsf", keep=("seq",))
    back = formats.parse_ocsf(lines)
    first, answer = F.get("dns.question", F.lit(0)), F.get("dns.answer", F.lit(0))
    return back.select(
        "seq", first["name"].alias("name"), first["qtype"].alias("qtype"),
        F.col("dns.rcode").alias("rcode"), answer["rdata"].alias("first_answer"),
    )


# --- packets ---------------------------------------------------------------------------------


def _network(df: DataFrame) -> DataFrame:
    """Text addresses and plain time for comparison."""
    shown = df.withColumns({c: ip_text_of(F.col(c)) for c in ("src_ip", "dst_ip")})
    return shown


@query("D1_headers")
def header_fields(spark, sf_dir):
    packets = traffic.udp_packets(spark, sf_dir)
    datagrams = headers.ip_datagrams(packets).filter("error IS NULL")
    fields = headers.transport(datagrams)
    return _network(fields).select(
        "seq", "ip_version", "src_ip", "dst_ip", "src_port", "dst_port"
    )


@query("D2_decapsulation")
def decapsulated(spark, sf_dir):
    """VLAN tags and VXLAN: every packet shows its inner addresses."""
    inner = headers.ip_datagrams(traffic.udp_packets(spark, sf_dir))
    return inner.groupBy("ip_version", "protocol_no").agg(F.count(F.lit(1)).alias("c"))


@query("D3_raw_ip")
def raw_ip(spark, sf_dir):
    packets = traffic.udp_packets(spark, sf_dir).filter("link_type = 101")
    return headers.ip_datagrams(packets, ethernet=False).select("seq", "ip_version")


@query("D5_udp_records")
def udp_records(spark, sf_dir):
    packets = traffic.udp_packets(spark, sf_dir)
    fields = headers.on_port(headers.transport(headers.ip_datagrams(packets).filter("error IS NULL")))
    out = _network(messages.udp_records(fields, 24, 112))
    return out.select(
        "seq", "ip_version", "src_ip", "src_port", "dst_ip", "dst_port", "protocol",
        F.col("dns.id").alias("id"), F.size("dns.question").alias("questions"),
        F.size("dns.answer").alias("answers"),
    )


def _fragments(spark, sf_dir):
    return headers.ip_datagrams(traffic.fragment_packets(spark, sf_dir))


@query("D7_D9_fragment_detection")
def fragment_detection(spark, sf_dir):
    found = _fragments(spark, sf_dir).groupBy("ip_version", "is_fragment", "more_fragments", "frag_offset")
    return found.agg(F.count(F.lit(1)).alias("c"))


def _rebuilt(rebuilt: DataFrame) -> DataFrame:
    decoded = messages.unpack(headers.transport(rebuilt))
    return _network(decoded).select(
        F.expr("seq div 4").alias("event"), "ip_version", "src_ip", "dst_port",
        F.col("dns.id").alias("id"), F.size("dns.answer").alias("answers"),
    )


@query("D8_reassemble_v4")
def reassemble_v4(spark, sf_dir):
    fragments = _fragments(spark, sf_dir).filter("ip_version = 4")
    return _rebuilt(reassemble_fragments(fragments))


@query("D10_reassemble_v6")
def reassemble_v6(spark, sf_dir):
    fragments = _fragments(spark, sf_dir).filter("ip_version = 6")
    return _rebuilt(reassemble_fragments(fragments))


@query("D11_fragment_limits")
def fragment_limits(spark, sf_dir):
    """Fragments moved far out: those past the size limit are refused."""
    from namestrata.operators.reassembly import sane_fragments

    moved = _fragments(spark, sf_dir).withColumn("frag_offset", F.col("frag_offset") + F.lit(8187))
    return sane_fragments(moved).select("seq", "frag_offset")


def _segments(spark, sf_dir):
    return headers.on_port(headers.transport(headers.ip_datagrams(traffic.tcp_packets(spark, sf_dir))))


@query("D12_D13_tcp_messages")
def tcp_reassembly(spark, sf_dir):
    out = tcp_messages(_segments(spark, sf_dir))
    decoded = messages.unpack(out)
    return decoded.groupBy(F.expr("seq div 8").alias("event"), F.col("dns.id").alias("id")).agg(
        F.count(F.lit(1)).alias("messages")
    )


@query("D6_tcp_records")
def tcp_records(spark, sf_dir):
    out = _network(messages.tcp_records(tcp_messages(_segments(spark, sf_dir)), 24, 112))
    return out.select(
        F.expr("seq div 8").alias("event"), "ip_version", "src_ip", "src_port", "protocol",
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("dns.id").alias("id"),
    )


@query("D14_decoding_errors")
def decoding_errors(spark, sf_dir):
    """Packets with broken headers (every 29th is cut short) and with broken messages, in one pass."""
    packets = traffic.udp_packets(spark, sf_dir)
    data = F.when(F.col("seq") % 29 == 0, F.substring("data", 1, 20)).otherwise(F.col("data"))
    fields = headers.with_layer_errors(headers.ip_datagrams(packets.withColumn("data", data)))
    payload = F.coalesce("payload", F.lit(b""))
    return metrics.decoding_counts(messages.unpack(fields.withColumn("payload", payload)))


@query("F1_port")
def on_port(spark, sf_dir):
    packets = traffic.udp_packets(spark, sf_dir)
    return headers.on_port(headers.transport(headers.ip_datagrams(packets))).select("seq")


@query("F2_default_traffic")
def default_traffic(spark, sf_dir):
    return headers.default_traffic(_fragments(spark, sf_dir)).select("seq", "ip_version")


@query("F3_port_range")
def port_range(spark, sf_dir):
    packets = traffic.udp_packets(spark, sf_dir)
    fields = headers.transport(headers.ip_datagrams(packets))
    return headers.port_range(fields, 1, 1024).select("seq", "src_port")


@query("U1_all_paths")
def all_paths(spark, sf_dir):
    """UDP packets, fragments and TCP segments through the whole capture plan."""
    parts = [
        traffic.udp_packets(spark, sf_dir),
        traffic.fragment_packets(spark, sf_dir).withColumn("file", F.lit("fragments")),
        traffic.tcp_packets(spark, sf_dir).withColumn("file", F.lit("tcp")),
    ]
    packets = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # Stored as a capture would be, so the packets are not derived anew for every path.
    out = packets_to_results(cut_lineage(packets, "capture"), columns=["protocol", "ip_version"])
    return out.groupBy("protocol", "ip_version").agg(F.count(F.lit(1)).alias("c"))


def _capture_query(kind: str) -> Query:
    """Packets read back from capture files in splits of a few records, and with them those written."""

    def run(spark, sf_dir):
        folder = shared_dir(spark, kind)
        traffic.write_captures(traffic.capture_files(spark, sf_dir, kind), folder)
        read = captures.read_captures(spark, folder, split_bytes=20_000)
        # Record numbers restart in every file; the time tells the event.
        read = read.select("ts_ns", "link_type", F.sha2("data", 256).alias("digest"))
        wrote = traffic.udp_packets(spark, sf_dir).select("seq", "ts_ns", F.sha2("data", 256).alias("digest"))
        return wrote.join(read, ["ts_ns", "digest"]).select("seq", "ts_ns", "link_type")

    return run


QUERIES["S1_pcap"] = _capture_query("pcap")
QUERIES["S2_pcapng"] = _capture_query("pcapng")


@query("S1_capture_source")
def captures_by_format(spark, sf_dir):
    """All packets of both formats through the data source: file, number there, and the event they show."""
    folder = shared_dir(spark, "captures")
    files = traffic.capture_files(spark, sf_dir, "pcap").unionByName(traffic.capture_files(spark, sf_dir, "pcapng"))
    traffic.write_captures(files, folder)
    read = capture_source.open_captures(spark, folder, split_bytes=20_000).select(
        F.element_at(F.split("file", "/"), -1).alias("file"), F.col("seq").alias("number"), "ts_ns", "link_type",
        F.sha2("data", 256).alias("digest"),
    )
    wrote = traffic.udp_packets(spark, sf_dir).select("seq", "ts_ns", F.sha2("data", 256).alias("digest"))
    return wrote.join(read, ["ts_ns", "digest"]).select("seq", "file", "number", "link_type")


@query("S3_format_sniffing")
def sniffing(spark, sf_dir):
    files = traffic.capture_files(spark, sf_dir, "pcap").unionByName(
        traffic.capture_files(spark, sf_dir, "pcapng")
    )
    return files.groupBy(captures.sniff(F.col("content")).alias("format")).agg(F.count(F.lit(1)).alias("c"))


@query("S4_dnstap")
def dnstap(spark, sf_dir):
    out = _network(protobuf.dnstap_results(traffic.dnstap_frames(spark, sf_dir)))
    return out.select(
        "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "ip_version", "src_ip", "src_port",
        "dst_ip", "protocol", "identity", "version", F.col("dns.id").alias("id"),
        F.size("dns.question").alias("questions"),
    )


@query("S4_dnstap_invalid")
def dnstap_invalid(spark, sf_dir):
    decoded = protobuf.decode_dnstap(traffic.dnstap_frames(spark, sf_dir))
    return decoded.filter("error IS NOT NULL").select("seq")


@query("P20_S9_event_records")
def event_records(spark, sf_dir):
    back = protobuf.read_events(traffic.event_records(spark, sf_dir), carried=("seq",))
    shown = messages.unpack(_network(back), "dns_wire")
    return shown.select(
        "seq", "ts_ns", "src_ip", "dst_ip", "src_port", "ip_version", "protocol", "packet_length",
        "identity", "qname", "qtype", F.col("rcode"), "is_response",
        F.col("dns.id").alias("id"),
    )


# --- sinks -----------------------------------------------------------------------------------


@query("K1_parquet_sink")
def parquet_sink(spark, sf_dir):
    path = shared_dir(spark, "parquet")
    tables.write_parquet(traffic.results(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("query_name", "qtype").agg(F.count(F.lit(1)).alias("c"))


@query("K2_file_sink")
def file_sink(spark, sf_dir):
    path = shared_dir(spark, "files")
    tables.write_files(traffic.results(spark, sf_dir), path, "csv", rotate="day", keep=10)
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    is_header = F.col("value") == formats.CSV_HEADER
    day = F.array_join(F.slice(F.split("value", ","), 1, 3), "-")
    return lines.filter(~is_header).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("c"))


@query("K3_S7_log_table")
def log_table(spark, sf_dir):
    path = shared_dir(spark, "log")
    tables.write_log(traffic.dns_log(spark, sf_dir), path)
    log = tables.read_log(spark, path).filter("dns_date = DATE'2024-01-15'")
    return log.groupBy("Server", "Type").agg(F.count(F.lit(1)).alias("c"), F.sum("Size").alias("size"))


@query("T2_storage_order")
def storage_order(spark, sf_dir):
    """Rows of the written log that break the order inside their file: none."""
    from pyspark.sql import Window

    path = shared_dir(spark, "log")
    tables.write_log(traffic.dns_log(spark, sf_dir), path)
    # The row number inside a file, from where Spark read it.
    log = tables.read_log(spark, path).select(
        "dns_date", "seq", F.struct(F.date_trunc("HOUR", "PacketTime"), "Server", "rq").alias("key"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    # A file holds a bounded number of rows.
    w = Window.partitionBy("file").orderBy("row")
    broken = log.withColumn("previous", F.lag("key").over(w)).filter("previous > key")
    return broken.select("seq")


@query("K6_console_lines")
def console(spark, sf_dir):
    lines = rows.explode_questions(traffic.results(spark, sf_dir))
    shown = lines.select("seq", formats.format_column("csv_no_header").alias("value"))
    return shown.groupBy((F.col("seq") % 10).alias("bucket")).agg(F.count("value").alias("c"))


@query("W7_fan_out")
def fan_out(spark, sf_dir):
    """Two outputs of one stream, one of them behind a skip list."""
    folder = shared_dir(spark, "fan-out")
    events = _event_stream(spark, sf_dir)
    skip = jobs.ReloadedList(lambda: domain_list_from(spark, SKIP_LINES))
    outputs = [
        ("parquet", 1, {"path": f"{folder}/all"}), ("parquet", 2, {"path": f"{folder}/kept"}),
        ("stdout", 0, {}),
    ]
    jobs.fan_out(traffic.results_of(events), outputs, f"{folder}/checkpoint", skip).awaitTermination()
    both = [
        spark.read.parquet(f"{folder}/{n}").select(F.lit(n).alias("output"), "query_name")
        for n in ("all", "kept")
    ]
    return both[0].unionByName(both[1]).groupBy("output").agg(F.count(F.lit(1)).alias("c"))


# --- streams ---------------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    schema = traffic.load_events(spark, sf_dir).schema
    return jobs.read_folder(spark, sf_dir, schema, names="events.parquet")


def _spread_stream(spark, sf_dir):
    """The event stream dealt out evenly, for the derivations that cost far more than a shuffle of it."""
    return _event_stream(spark, sf_dir).repartition(traffic.event_tasks(spark, sf_dir))


def _log_stream(spark, sf_dir):
    log = traffic.log_of(_event_stream(spark, sf_dir))
    return log.withColumn("PacketTime", F.col("PacketTime").cast("timestamp"))


@query("W1_dedup_stream")
def dedup_stream(spark, sf_dir):
    """One row per payload and day; most rows are copies. Which copy is first depends on the stream's order."""
    log = _log_stream(spark, sf_dir).select("seq", F.col("PacketTime").alias("ts"), F.expr(_COPIED_DATA).alias("data"))
    kept = jobs.run_to_end(jobs.drop_copies_stream(log, 86400), "dedup")
    return kept.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("c"))


@query("W2_fragment_stream")
def fragment_stream(spark, sf_dir):
    packets = traffic.fragment_packets_of(_spread_stream(spark, sf_dir))
    stream = reassemble_fragments_stream(headers.ip_datagrams(packets))
    rebuilt = jobs.run_to_end(stream, "fragments")
    return rebuilt.groupBy("ip_version").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.expr("seq div 4")).alias("events")
    )


@query("W3_tcp_stream")
def tcp_stream(spark, sf_dir):
    packets = traffic.tcp_packets_of(_spread_stream(spark, sf_dir))
    segments = headers.on_port(headers.transport(headers.ip_datagrams(packets)))
    out = jobs.run_to_end(tcp_messages_stream(segments), "tcp")
    return out.groupBy("ip_version").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.expr("seq div 8")).alias("events")
    )


@query("W4_rollup_tables")
def rollup_tables(spark, sf_dir):
    """Rollups kept by a stream of blocks, merged on read."""
    folder = shared_dir(spark, "rollups")
    log = _log_stream(spark, sf_dir)
    names = ["type", "general"]
    jobs.maintain_rollups(log, f"{folder}/tables", f"{folder}/checkpoint", names).awaitTermination()
    merged = jobs.read_rollup(spark, f"{folder}/tables", "type", "day")
    return merged.select("DnsDate", "Server", "Type", "c")


@query("W4_windowed_rollup")
def windowed_rollup(spark, sf_dir):
    """All windows: those a stream closes, and the newest at the end of it."""
    end = shared_dir(spark, "end")
    log = jobs.with_end(_log_stream(spark, sf_dir), end, "PacketTime")
    stream = jobs.windowed_rollup(log, "opcode", "1 day", "0 seconds")
    closed = jobs.run_to_end(stream, "windows", end=end)
    return closed.select("DnsDate", "Server", "OpCode", "c")


@query("W9_progress_counters")
def progress_counters(spark, sf_dir):
    """Counters observed while rows are written."""
    log, watch = metrics.observe_counts(
        traffic.dns_log(spark, sf_dir), "log", responses=F.col("QR") == 1
    )
    log.write.parquet(shared_dir(spark, "observed"))
    seen = watch.get
    counted = traffic.dns_log(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("QR") == 1).alias("responses")
    )
    return counted.select(
        "rows", "responses", (F.col("rows") == seen["rows"]).alias("rows_equal"),
        (F.col("responses") == seen["responses"]).alias("responses_equal"),
    )


@query("W5_W6_batches")
def stream_batches(spark, sf_dir):
    """Full batches of 500 lines per server, and the rest of each server after a second."""
    log = _log_stream(spark, sf_dir).select("Server", F.col("Question").alias("value"))
    out = run_until_flushed(batches_stream(log, "Server", 500, 1), "batches", 1)
    lines = F.size(F.split("value", "\n"))
    return out.groupBy("Server").agg(
        F.count_if(F.col("rows") == 500).alias("full"), F.sum(F.when(F.col("rows") < 500, F.col("rows")).otherwise(0)).alias("rest"),
        F.sum(lines).alias("lines"), F.count_distinct("batch").alias("batches"),
    )


@query("W9_stored_counters")
def stored_counters(spark, sf_dir):
    """Counters of a stream that is stopped after half of its input and started again."""
    folder = shared_dir(spark, "counted")
    events = traffic.load_events(spark, sf_dir)
    half = F.pmod(F.xxhash64(*events.columns), F.lit(2))
    for part in (0, 1):
        events.filter(half == part).write.mode("append").parquet(f"{folder}/in")
        log = traffic.log_of(jobs.read_folder(spark, f"{folder}/in", events.schema))
        seen = log.observe("log", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("QR") == 1).alias("responses"))
        writer = seen.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        run = writer.trigger(availableNow=True).start(f"{folder}/out")
        run.awaitTermination()
        counters = jobs.StoredCounters(spark, f"{folder}/counters")
        for progress in run.recentProgress:
            counters.record(progress)
    return counters.stored()
