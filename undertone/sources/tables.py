"""Tables as signals, frames and segments. Every sequence carries an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds idx, the position within key from 0 on."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint") - 1)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_id, idx, x and event columns: the events of a user in time order as samples."""
    events = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "signal_id", "value": "x"})
    return ordered(events, "signal_id", "ts", "event_id").select("signal_id", "idx", "x", "event_id", "event_type", "ts")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_id (the label), f (frame number) and samples: embeddings as frames of 64 samples."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("signal_id"), F.col("vec_id").alias("f"), F.col("embedding").cast("array<double>").alias("samples"))
    return rows
