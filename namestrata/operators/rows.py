"""Results to table rows: one row per question in the layouts of the stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namestrata.functions.formats import do_bit, edns_present, format_column, qr_flag
from namestrata.functions.ip import to_16
from namestrata.schemas import DNS_LOG_COLUMNS


def explode_questions(results: DataFrame) -> DataFrame:
    """One row per question, in ``q``; messages without one vanish.

    Rows that already are per question (they passed a domain filter) stay as they are.
    """
    if "q" in results.columns:
        return results
    return results.select("*", F.explode("dns.question").alias("q"))


def server_identity(server: str, use_identity: bool = False) -> Column:
    """The configured server name, or the identity that came with a dnstap frame."""
    return F.coalesce(F.col("identity"), F.lit("")) if use_identity else F.lit(server)


def full_query(keep: bool, fmt: str = "json") -> Column:
    return format_column(fmt) if keep else F.lit("")


def dns_log_rows(
    results: DataFrame,
    server: str = "default",
    use_identity: bool = False,
    save_full_query: bool = False,
) -> DataFrame:
    """Rows of the flat log in table order, addresses in 16-byte form."""
    dns, q = F.col("dns"), F.col("q")
    rows = explode_questions(results)
    values = [
        F.col("ts"), F.current_timestamp(), server_identity(server, use_identity),
        F.col("ip_version"), to_16(F.col("src_ip")), to_16(F.col("dst_ip")), F.col("protocol"),
        qr_flag(dns), dns["opcode"], q["qclass"], q["qtype"], edns_present(dns), do_bit(dns),
        full_query(save_full_query), dns["rcode"].bitwiseAND(0xFF), q["name"],
        F.col("packet_length"),
    ]
    return rows.select(*[v.alias(n) for v, n in zip(values, DNS_LOG_COLUMNS)])


def postgres_rows(results: DataFrame, server: str = "default", save_full_query: bool = False) -> DataFrame:
    """The same seventeen columns for a relational table, with addresses as text."""
    from namestrata.functions.ip import ip_text

    rows = dns_log_rows(results, server, save_full_query=save_full_query)
    return rows.withColumns({c: ip_text(F.col(c)) for c in ("SrcIP", "DstIP")})


def parquet_rows(results: DataFrame) -> DataFrame:
    """The sixteen columns of the Parquet output."""
    dns, q = F.col("dns"), F.col("q")
    rows = explode_questions(results)
    return rows.select(
        F.col("ts").alias("timestamp"), "ip_version", "src_ip", "dst_ip", "protocol",
        qr_flag(dns).alias("qr"), dns["opcode"].alias("opcode"), q["qclass"].alias("qclass"),
        q["qtype"].alias("qtype"), edns_present(dns).alias("edns"), do_bit(dns).alias("do_bit"),
        dns["rcode"].alias("rcode"), q["name"].alias("query_name"), "packet_length", "identity",
        "version",
    )


def with_storage_key(log: DataFrame) -> DataFrame:
    """Add the storage order columns: hour bucket ``hour`` and reversed name ``rq``."""
    from namestrata.functions.timing import truncate

    return log.withColumns({"hour": truncate(log, "PacketTime", "hour"), "rq": F.reverse("Question")})


def question_hash() -> Column:
    """64-bit key of the question, for grouping and sampling only."""
    return F.xxhash64("Question")
