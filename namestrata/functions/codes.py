"""Code to name tables and their lookups.

Two label sets exist side by side: the *protocol* names used inside OCSF records
(``NOERROR``) and the *dictionary* names used by reports (``NoErr``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Protocol names by code (IANA registries).
TYPE_NAMES = {
    0: "None", 1: "A", 2: "NS", 3: "MD", 4: "MF", 5: "CNAME", 6: "SOA", 7: "MB", 8: "MG",
    9: "MR", 10: "NULL", 12: "PTR", 13: "HINFO", 14: "MINFO", 15: "MX", 16: "TXT", 17: "RP",
    18: "AFSDB", 19: "X25", 20: "ISDN", 21: "RT", 23: "NSAP-PTR", 24: "SIG", 25: "KEY",
    26: "PX", 27: "GPOS", 28: "AAAA", 29: "LOC", 30: "NXT", 31: "EID", 32: "NIMLOC", 33: "SRV",
    34: "ATMA", 35: "NAPTR", 36: "KX", 37: "CERT", 39: "DNAME", 41: "OPT", 42: "APL", 43: "DS",
    44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 49: "DHCID",
    50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 53: "SMIMEA", 55: "HIP", 56: "NINFO",
    57: "RKEY", 58: "TALINK", 59: "CDS", 60: "CDNSKEY", 61: "OPENPGPKEY", 62: "CSYNC",
    63: "ZONEMD", 64: "SVCB", 65: "HTTPS", 99: "SPF", 100: "UINFO", 101: "UID", 102: "GID",
    103: "UNSPEC", 104: "NID", 105: "L32", 106: "L64", 107: "LP", 108: "EUI48", 109: "EUI64",
    249: "TKEY", 250: "TSIG", 251: "IXFR", 252: "AXFR", 253: "MAILB", 254: "MAILA",
    255: "ANY", 256: "URI", 257: "CAA", 258: "AVC", 260: "AMTRELAY", 32768: "TA",
    32769: "DLV", 65535: "Reserved",
}
CLASS_NAMES = {1: "IN", 2: "CS", 3: "CH", 4: "HS", 254: "NONE", 255: "ANY"}
OPCODE_NAMES = {0: "QUERY", 1: "IQUERY", 2: "STATUS", 4: "NOTIFY", 5: "UPDATE"}
RCODE_NAMES = {
    0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED",
    6: "YXDOMAIN", 7: "YXRRSET", 8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE", 16: "BADSIG",
    17: "BADKEY", 18: "BADTIME", 19: "BADMODE", 20: "BADNAME", 21: "BADALG", 22: "BADTRUNC",
    23: "BADCOOKIE",
}

# Report dictionaries, id to label.
TYPE_DICTIONARY = {
    0: "None", 1: "A", 2: "NS", 3: "MD", 4: "MF", 5: "CNAME", 6: "SOA", 7: "MB", 8: "MG",
    9: "MR", 10: "NULL", 11: "WKS", 12: "PTR", 13: "HINFO", 14: "MINFO", 15: "MX", 16: "TXT",
    17: "RP", 18: "AFSDB", 19: "X25", 20: "ISDN", 21: "RT", 23: "NSAPPTR", 24: "SIG",
    25: "KEY", 26: "PX", 27: "GPOS", 28: "AAAA", 29: "LOC", 30: "NXT", 31: "EID",
    32: "NIMLOC", 33: "SRV", 34: "ATMA", 35: "NAPTR", 36: "KX", 37: "CERT", 39: "DNAME",
    41: "OPT", 43: "DS", 44: "SSHFP", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 49: "DHCID",
    50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 53: "SMIMEA", 55: "HIP", 56: "NINFO",
    57: "RKEY", 58: "TALINK", 59: "CDS", 60: "CDNSKEY", 61: "OPENPGPKEY", 99: "SPF",
    100: "UINFO", 101: "UID", 102: "GID", 103: "UNSPEC", 104: "NID", 105: "L32", 106: "L64",
    107: "LP", 108: "EUI48", 109: "EUI64", 249: "TKEY", 250: "TSIG", 251: "IXFR",
    252: "AXFR", 253: "MAILB", 254: "MAILA", 255: "ANY", 256: "URI", 257: "CAA", 258: "AVC",
    32768: "TA", 32769: "DLV", 65535: "Reserved",
}
CLASS_DICTIONARY = {
    1: "Internet", 2: "CSNET (Obsolete)", 3: "CHAOS", 4: "Hesiod", 254: "NONE", 255: "AnyClass",
}
OPCODE_DICTIONARY = {0: "Query", 1: "IQuery (Obsolete)", 2: "Status", 4: "Notify", 5: "Update"}
RCODE_DICTIONARY = {
    0: "NoErr", 1: "FormErr", 2: "ServFail", 3: "NXDomain", 4: "NotImp", 5: "Refused",
    6: "YXDomain", 7: "YXRRSet", 8: "NXRRSet", 9: "NotAuth", 10: "NotZone", 16: "BadSig",
    17: "BadKey", 18: "BadTime", 19: "BadMode", 20: "BadName", 21: "BadAlg", 22: "BadTruc",
    23: "BadCookie",
}

#: dictionary name -> (log column it explains, entries)
DICTIONARIES = {
    "type": ("Type", TYPE_DICTIONARY),
    "class": ("Class", CLASS_DICTIONARY),
    "opcode": ("OpCode", OPCODE_DICTIONARY),
    "response": ("ResponseCode", RCODE_DICTIONARY),
}

_DENSE = 261


def name_of(code: Column, names: dict[int, str]) -> Column:
    """Protocol name of ``code``, '' when unknown.

    The table is one constant array indexed by code, so a lookup costs the same for
    every code; the few codes beyond it are compared one by one.
    """
    labels = ", ".join(f"'{names.get(i, '')}'" for i in range(min(_DENSE, max(names) + 1)))
    found = F.get(F.expr(f"array({labels})"), code.cast("int"))
    for number, label in names.items():
        if number >= _DENSE:
            found = F.when(code == number, label).otherwise(found)
    return F.coalesce(found, F.lit(""))


def code_of(name: Column, names: dict[int, str]) -> Column:
    """Inverse of :func:`name_of`; 0 when unknown."""
    table = F.expr("map(" + ", ".join(f"'{label}', {n}" for n, label in names.items()) + ")")
    return F.coalesce(F.try_element_at(table, name), F.lit(0)).cast("int")


def dictionary(spark: SparkSession, which: str, path: str | None = None) -> DataFrame:
    """``Id BIGINT, Name STRING`` of a dictionary: the built-in one or a TSV file."""
    schema = "Id BIGINT, Name STRING"
    if path:
        return spark.read.csv(path, sep="\t", schema=schema)
    return spark.createDataFrame(sorted(DICTIONARIES[which][1].items()), schema)


def with_label(
    log: DataFrame, which: str, path: str | None = None, column: str | None = None
) -> DataFrame:
    """Add ``<Column>Name``; codes missing from the dictionary become ``Invalid``.

    A dictionary has one row per 16-bit code at most (65 536), which bounds the
    broadcast side whatever the log's size.
    """
    key = column or DICTIONARIES[which][0]
    small = dictionary(log.sparkSession, which, path)
    small = small.filter("Id BETWEEN 0 AND 65535").groupBy("Id").agg(F.last("Name").alias("Name"))
    joined = log.join(F.broadcast(small), F.col(key).cast("bigint") == F.col("Id"), "left")
    return joined.withColumn(f"{key}Name", F.coalesce("Name", F.lit("Invalid"))).drop("Id", "Name")
