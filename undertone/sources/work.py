"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder for tables, sinks and checkpoints, below the one that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="streams-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: lineage ends here, and nothing above is computed again."""
    path = f"{work_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """Deletes tables of `stored` that nothing reads any more, and returns df."""
    spark = df.sparkSession
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return df
