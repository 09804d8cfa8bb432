"""Retention, partition cleanup and read-side sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def within_retention(df: DataFrame, day_column: str, as_of: str, days: int = 30) -> DataFrame:
    """Rows whose date plus ``days`` has not passed at ``as_of``.

    A plain comparison on the day column, so it prunes partitions when that column is
    the partition column.
    """
    return df.filter(F.col(day_column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def expired_partitions(
    spark: SparkSession, path: str, as_of: str, days: int = 31, column: str = "dns_date"
) -> list[str]:
    """Partition folders of a day-partitioned table older than ``days``."""
    folder, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    limit = spark.sql(f"SELECT CAST(date_sub(DATE'{as_of}', {int(days)}) AS STRING)").first()[0]
    return sorted(
        n for n in names if n.startswith(f"{column}=") and n.split("=", 1)[1][:10] < limit
    )


def drop_expired_partitions(
    spark: SparkSession, path: str, as_of: str, days: int = 31, column: str = "dns_date"
) -> list[str]:
    """Delete the folders :func:`expired_partitions` lists and return their names."""
    gone = expired_partitions(spark, path, as_of, days, column)
    folder, fs = _folder(spark, path)
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
    return gone


def drop_oldest_folders(spark: SparkSession, path: str, keep: int, levels: int = 2, above: int = 0) -> list[str]:
    """Delete all but the newest ``keep`` folders ``levels`` deep, whose names sort by time.

    With ``above``, these lie below so many levels of other folders, blocks of a stream, and folders
    of one name in several of them stay or go together.
    """
    folder, fs = _folder(spark, path)
    found = [(folder, ())]
    for level in range(above + levels):
        found = [
            (s.getPath(), (*name, s.getPath().getName()) if level >= above else name)
            for f, name in found for s in fs.listStatus(f) if s.isDirectory()
        ]
    stay = set(sorted({name for _, name in found})[-keep:] if keep > 0 else [])
    gone = [p for p, name in sorted(found, key=lambda x: (x[1], x[0].toString())) if name not in stay]
    for old in gone:
        fs.delete(old, True)
    return [p.toString() for p in gone]


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def key_sample(df: DataFrame, keep: int, out_of: int, *keys: str) -> DataFrame:
    """Deterministic sample by key: the same key is always in or always out."""
    if not 0 <= keep <= out_of or out_of < 1:
        raise ValueError(f"cannot keep {keep} of {out_of}")
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(out_of)) < keep)


def modulo_sample(df: DataFrame, number_column: str, keep: int, out_of: int) -> DataFrame:
    """Sample on a numeric key by remainder (type, opcode, class, unix time)."""
    return df.filter(F.pmod(F.col(number_column), F.lit(out_of)) < keep)
