"""Options of OPT records against lists written by hand."""

import json

from pyspark.sql import functions as F

from namestrata.functions import edns, formats


def shown(spark, *datas):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(datas)], "i INT, rdata STRING")
    record = F.struct(
        F.lit(".").alias("name"), F.lit(41).alias("rrtype"), F.lit(1232).alias("class"), F.lit(0).alias("ttl"),
        F.lit(9).alias("rdlength"), "rdata",
    )
    got = rows.select("i", formats._record_json(record).alias("v"), edns.options(F.col("rdata")).alias("o")).orderBy("i")
    return [(json.loads(r.v) if r.v else None, [(o.code, o.hex) for o in r.o]) for r in got.collect()]


def generic(hexa):
    return f"\\# {len(hexa) // 2} {hexa}"


def test_options(spark):
    three = "00080007000118000A0102" + "000A0008AABBCCDDEEFF0011" + "000300026E73"
    six = "0008000B0002380020010DB8AABBCC"
    others = "000F0006001268C3A96C" + "000C0002" + "0000" + "00050002080D" + "FDE90003BEEF01" + "FDEA0000"
    cut = "00030001AA" + "000A0008AABB"
    bad = "000800020001" + "000F000112"
    got = shown(spark, *map(generic, (three, six, others, cut, bad)), "")
    assert got[0][0]["Option"] == [
        {"Code": 8, "Family": 1, "SourceNetmask": 24, "SourceScope": 0, "Address": "10.1.2.0"},
        {"Code": 10, "Cookie": "aabbccddeeff0011"}, {"Code": 3, "Nsid": "6e73"},
    ]
    assert got[0][1] == [(8, "000118000A0102"), (10, "AABBCCDDEEFF0011"), (3, "6E73")]
    assert got[1][0]["Option"][0]["Address"] == "2001:db8:aabb:cc00::"
    assert got[2][0]["Option"] == [
        {"InfoCode": 18, "ExtraText": "hél"}, {"Padding": "AAA="}, {"Code": 5, "AlgCode": "CA0="},
        {"Code": 65001, "Data": "vu8B"}, {"Code": 65002, "Data": ""},
    ]
    assert got[3][1] == [(3, "AA")]
    assert got[4][0]["Option"] == [{"Code": 8, "Data": "AAE="}, {"Code": 15, "Data": "Eg=="}]
    assert got[5][1] == [] and "Option" not in got[5][0]


def test_family_without_address(spark):
    ((record, _),) = shown(spark, generic("0008000400000000"))
    assert record["Option"][0]["Address"] == "0.0.0.0"


def test_many_and_missing(spark):
    (_, none), (_, many) = shown(spark, None, generic("FDE90000" * 500))
    assert none == [] and many == [(65001, "")] * 500
