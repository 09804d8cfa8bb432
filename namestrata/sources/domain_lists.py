"""Domain lists: lines of ``pattern,kind`` to a normalised pattern table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("prefix", "suffix", "fqdn")


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file with their line numbers: ``line_no BIGINT, line STRING``.

    Line order matters (the last entry of a key wins) and a list is limited in size by
    contract (100 MB), so each file is read as one text value and split in place.
    """
    text = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.regexp_replace("value", r"\r?\n$", "").alias("value")
    )
    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    if path.rstrip("/").endswith(("*", "}")):
        # Several files: order them by name, then by line.
        files = text.select("file").withColumn(
            "file_no", F.row_number().over(Window.orderBy("file")).cast("bigint")
        )
        lines = lines.join(files, "file").withColumn(
            "line_no", F.col("file_no") * F.lit(1 << 32) + F.col("pos")
        )
    else:
        lines = lines.withColumn("line_no", F.col("pos").cast("bigint"))
    return lines.select("line_no", "line")


def parse_domain_list(lines: DataFrame) -> DataFrame:
    """Normalise ``line_no, line`` to one row per pattern and role.

    Result: ``role`` (prefix, suffix or fqdn), ``pattern``, ``size`` and ``active``. A line
    without exactly one comma, or with an unknown kind, is a full name. Patterns of every
    role share one table of kinds in which suffixes are entered reversed and the last line
    wins; a prefix or suffix pattern whose entry was later given another kind still takes
    part in the longest-match search but is not ``active``.
    """
    parts = F.split(F.lower("line"), ",", -1)
    valid = F.size(parts) == 2
    named = lines.select(
        "line_no",
        F.when(valid, F.get(parts, F.lit(0))).otherwise(F.lower("line")).alias("pattern"),
        F.when(valid & F.get(parts, F.lit(1)).isin(*KINDS), F.get(parts, F.lit(1)))
        .otherwise(F.lit("fqdn"))
        .alias("role"),
    )
    entry = F.when(F.col("role") == "suffix", F.reverse("pattern")).otherwise(F.col("pattern"))
    named = named.withColumn("entry", entry)
    kinds = named.groupBy("entry").agg(F.max_by("role", "line_no").alias("kind"))
    return (
        named.select("entry", "role", "pattern")
        .distinct()
        .join(kinds, "entry")
        .select(
            "role",
            "pattern",
            F.length("pattern").alias("size"),
            (F.col("kind") == F.col("role")).alias("active"),
        )
        .filter((F.col("role") != "fqdn") | F.col("active"))
        .filter((F.col("role") == "fqdn") | (F.col("size") > 0))
    )


def load_domain_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_domain_list(read_domain_list(spark, path))


def domain_list_from(spark: SparkSession, entries: list[str]) -> DataFrame:
    """A pattern table from lines already in hand (configuration, tests)."""
    rows = list(enumerate(entries))
    return parse_domain_list(spark.createDataFrame(rows, "line_no BIGINT, line STRING"))
