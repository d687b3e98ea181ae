"""Catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def catalog_table(spark: SparkSession, database: str, table: str, predicate: str | None = None) -> DataFrame:
    """A table of the session catalog; a predicate on partition columns prunes partitions before listing files."""
    df = spark.table(f"`{database}`.`{table}`")
    return df.where(predicate) if predicate else df
