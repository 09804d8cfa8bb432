"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches carry whole packets, so they are bounded in rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def get_session(app: str = "namestrata", **conf: str) -> SparkSession:
    """A session with the settings every job here expects; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors all see.

    Lives below ``spark.checkpoint.dir``. Where that is unset, a temporary folder stands in
    for it if the session runs in one process; on a cluster every executor would write to a
    disk of its own and later reads would miss the rows, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="namestrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df, purpose: str):
    """Write ``df`` to the shared folder and read it back.

    The written table replaces the lineage, so a lost executor costs one reread
    and not the whole history of an iterative job.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
