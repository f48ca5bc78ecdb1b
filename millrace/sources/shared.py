"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are removed when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where the session names none, a local master gets one of its own; on a cluster that is an error, as executors would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        Path("/tmp/checkpoints").mkdir(exist_ok=True)
        base = f"file://{tempfile.mkdtemp(prefix='millrace-', dir='/tmp/checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor costs only a read. The shuffles of the write leave the disks with its end, as nothing reads them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)
