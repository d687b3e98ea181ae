"""JDBC, pass-through connectors and literal rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def jdbc(
    spark: SparkSession,
    url: str,
    *,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table or query. Filters and column lists reach the database.

    Without a partition column the whole table comes through one task, so give one (with its bounds and a
    partition count) for anything large.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    reader = spark.read.format("jdbc").option("url", url).options(**dict(options or {}))
    if partition_column:
        if bounds is None or partitions is None:
            raise ValueError("partitioned reads need bounds and a partition count")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", str(partitions))
            .option("dbtable", table or f"({query}) q")
        )
    else:
        reader = reader.option("dbtable", table) if table else reader.option("query", query)
    return reader.load()


def connector(spark: SparkSession, fmt: str, options: Mapping[str, str] | None = None, path: str | None = None) -> DataFrame:
    """Any data source on the classpath by its format name."""
    reader = spark.read.format(fmt).options(**dict(options or {}))
    return reader.load(path) if path else reader.load()


def rows(spark: SparkSession, data: Iterable, schema: T.StructType | str) -> DataFrame:
    """Rows held by the caller; always with a schema, so an empty list keeps its columns."""
    return spark.createDataFrame(data, schema)
