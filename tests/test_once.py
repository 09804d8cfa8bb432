"""Columns and records that are made once, and the expressions they are made of."""

import json

from pyspark.sql import functions as F

from namestrata.functions import formats, once
from namestrata.functions.binary import hex_uint
from namestrata.plans import traffic
from tests.conftest import SF


def test_a_lambda_does_not_stop_compilation(spark):
    """What ``compute_once`` adds is made in a projection, one expression for all that reads it."""
    rows = once.compute_once(spark.range(9), {"v": F.aggregate(F.sequence(F.lit(0), "id"), F.lit(0).cast("long"), lambda a, x: a + x)})
    rows = rows.filter("v > 5").filter("v IS NOT NULL")
    assert [r.v for r in rows.orderBy("id").collect()] == [6, 10, 15, 21, 28, 36]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") == 1
    assert "aggregate(" not in "".join(line for line in plan.splitlines() if "Generate" in line)


def test_records_are_rendered_once(spark):
    shown = formats.render(traffic.results(spark, SF), "json", keep=("seq",)).filter("seq > 3")
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert plan.count(',"IPVersion":') == 1


def test_quotes_of_odd_texts(spark):
    texts = ['a"b', "}", "{}}", "", "\\", "\n}\t", '"}', "ä\u0001", '{"v":"x"}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", formats.quote(F.col("t")).alias("q"))
    for r in rows.collect():
        assert r.q == "" if r.t is None else json.loads(r.q) == r.t


def test_hex_of_any_integer(spark):
    values = [0, 1, 255, 256, 65535, 1 << 31, (1 << 32) - 1, 1 << 40, (1 << 63) - 1, -1, -256, -(1 << 63)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    for width in range(1, 9):
        got = rows.select("v", hex_uint(F.col("v"), width).alias("h")).collect()
        assert [r.h for r in got] == [f"{r.v & ((1 << 8 * width) - 1):0{2 * width}X}" for r in got]
