"""Rows as JSON files, split into folders by columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def export_json(df: DataFrame, folder: str, *split: str) -> None:
    """One line a row; readers that ask for few values of the split columns open few files."""
    df.write.mode("overwrite").partitionBy(*split).json(folder)


def import_json(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of a declared schema; malformed lines give nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(folder)
