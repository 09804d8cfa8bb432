"""Payload frames of the network outputs, as DataFrame columns.

The frames are what the outputs would send; sending them is left to a connector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namestrata.functions.formats import (
    do_bit,
    edns_present,
    format_column,
    to_event_bytes,
)
from namestrata.functions.ip import ip_text
from namestrata.functions.once import compute_once
from namestrata.operators.ordering import RANGE
from namestrata.operators.rows import explode_questions
from namestrata.operators.sampling import flush_number


def per_question(results: DataFrame, fmt: str = "json", **options) -> DataFrame:
    """``seq, name, value``: the rendered record once per question."""
    rows = explode_questions(results)
    shown = compute_once(rows, {"name": F.col("q.name"), "value": format_column(fmt, **options)})
    return shown.select("seq", "ts", "ts_ns", "name", "value").filter("value IS NOT NULL")


def elastic_documents(results: DataFrame) -> DataFrame:
    return per_question(results).select("seq", "name", "value")


def zinc_bulk(results: DataFrame, index: str = "dns", fmt: str = "json") -> DataFrame:
    """A bulk pair per message: the index line and the record line. No domain filter here."""
    prefix = F.lit(f'{{ "index" : {{ "_index" : "{index}" }} }}\n')
    value = F.concat(prefix, format_column(fmt), F.lit("\n"))
    return results.select("seq", value.alias("value"))


def splunk_events(
    results: DataFrame, source: str = "dns", sourcetype: str = "dns", index: str = "main", fmt: str = "json"
) -> DataFrame:
    event = F.struct(
        F.unix_seconds("ts").alias("time"), F.col("value").alias("event"), F.lit(source).alias("source"),
        F.lit(sourcetype).alias("sourcetype"), F.lit(index).alias("index"),
    )
    return per_question(results, fmt).select("seq", "name", F.to_json(event).alias("value"))


def batched(rows: DataFrame, size: int, opening: str, separator: str, closing: str) -> DataFrame:
    """Join ``value`` of every ``size`` rows, in ``seq`` order: ``batch, rows, value``.

    A batch holds ``size`` rows at most, so no payload grows with the data.
    """
    if size < 1:
        raise ValueError("a batch holds at least one record")
    # ``__row`` steps by 65 536 per message, so ranges are that much wider.
    numbered = flush_number(rows, size, order="__row", width=RANGE << 16)
    members = F.array_sort(F.collect_list(F.struct("__row", "value")))
    body = F.array_join(F.transform(members, lambda m: m["value"]), separator)
    packed = F.concat(F.lit(opening), body, F.lit(closing))
    return numbered.groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"), packed.alias("value")
    )


def _row_order(rows: DataFrame) -> DataFrame:
    """A unique order column: arrival number, then question (at most 65 536 per message)."""
    return rows.withColumn("__row", F.col("seq") * F.lit(1 << 16) + F.col("pos"))


def _positioned(results: DataFrame, fmt: str, **options) -> DataFrame:
    rows = results.select("*", F.posexplode("dns.question").alias("pos", "q"))
    shown = rows.select("seq", "pos", format_column(fmt, **options).alias("value"))
    return _row_order(shown.filter("value IS NOT NULL"))


def sentinel_batches(results: DataFrame, size: int = 100, fmt: str = "json") -> DataFrame:
    """JSON arrays of ``size`` records."""
    return batched(_positioned(results, fmt), size, "[", ",", "]")


def victoria_batches(results: DataFrame, size: int = 100, fmt: str = "json-ocsf", **options) -> DataFrame:
    """Newline-joined records, ``size`` per batch."""
    return batched(_positioned(results, fmt, **options), size, "", "\n", "")


def syslog_lines(results: DataFrame, server: str = "default", fmt: str = "json") -> DataFrame:
    """Lines at priority 9 (user facility, alert), tagged with the server name."""
    line = F.concat(F.lit(f"<9>{server}: "), F.col("value"))
    return per_question(results, fmt).select("seq", "name", line.alias("value"))


def kafka_records(results: DataFrame, fmt: str = "json") -> DataFrame:
    """Random 128-bit key, rendered record."""
    key = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    value = format_column(fmt).cast("binary")
    return results.select(key.cast("binary").alias("key"), value.alias("value"))


def nats_events(results: DataFrame) -> DataFrame:
    return results.select("seq", to_event_bytes().alias("value"))


def _tag(text: Column) -> Column:
    return F.regexp_replace(text, r"([,= ])", r"\\$1")


def influx_points(results: DataFrame, server: str = "default") -> DataFrame:
    """Line protocol: measurement ``system``, tag ``hostname``, fourteen fields sorted by name."""
    rows = explode_questions(results)
    dns, q = F.col("dns"), F.col("q")

    def text(value: Column) -> Column:
        escaped = F.regexp_replace(value, r'(["\\])', r"\\$1")
        return F.concat(F.lit('"'), escaped, F.lit('"'))

    def number(value: Column) -> Column:
        return F.concat(value.cast("string"), F.lit("i"))

    def unsigned(value: Column) -> Column:
        return F.concat(value.cast("string"), F.lit("u"))

    fields = {
        "DstIP": text(ip_text(F.col("dst_ip"))), "SrcIP": text(ip_text(F.col("src_ip"))),
        "class": unsigned(q["qclass"]), "dobit": unsigned(do_bit(dns)),
        "edns": unsigned(edns_present(dns)), "id": unsigned(dns["id"]),
        "ipversion": unsigned(F.col("ip_version")), "opCode": number(dns["opcode"]),
        "protocol": text(F.col("protocol")), "qr": dns["response"].cast("string"),
        "qtype": unsigned(q["qtype"]), "question": text(q["name"]),
        "responseCode": number(dns["rcode"]), "size": unsigned(F.col("packet_length")),
    }
    pairs = [F.concat(F.lit(f"{k}="), v) for k, v in fields.items()]
    line = F.concat(
        F.lit("system,hostname="), _tag(F.lit(server)), F.lit(" "), F.concat_ws(",", *pairs),
        F.lit(" "), F.col("ts_ns").cast("string"),
    )
    return rows.select("seq", q["name"].alias("name"), line.alias("value"))




#: Frames by name of the output that sends them.
FRAMES = {
    "elastic": elastic_documents, "zinc": zinc_bulk, "splunk": splunk_events, "syslog": syslog_lines,
    "nats": nats_events, "influx": influx_points,
}


def write_frames(results: DataFrame, name: str, path: str, mode: str = "append") -> None:
    """Frames as a table (seq, value) that a sender can read."""
    FRAMES[name](results).select("seq", "value").write.mode(mode).parquet(path)
