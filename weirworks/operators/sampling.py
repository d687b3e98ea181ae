"""Sample capture: rows of a source kept as JSON lines, with a manifest of what was kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "node string, path string, format string, rows bigint, captured timestamp, kind string, source string"


def _record(kept: DataFrame, node: str, home: str, kind: str, source: str | None) -> DataFrame:
    spark, path = kept.sparkSession, f"{home}/samples/{node}"
    seen = Observation(f"{node}-sample")
    kept.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(path)
    row = spark.createDataFrame([(node, path, "json", seen.get["rows"], kind, source)], "node string, path string, format string, rows bigint, kind string, source string")
    entry = row.withColumn("captured", F.current_timestamp()).select("node", "path", "format", "rows", "captured", "kind", "source")
    # One folder per node, so a new capture replaces the node's entry and leaves the others alone.
    entry.write.mode("overwrite").parquet(f"{home}/manifest/node={node}")
    return spark.read.schema(MANIFEST).parquet(f"{home}/manifest/node={node}")


def capture(df: DataFrame, node: str, home: str, *, rows: int = 50, order: Sequence[str] = (), source: str | None = None) -> DataFrame:
    """Keep the first rows of a source and return its manifest entry."""
    return _record((df.orderBy(*order) if order else df).limit(rows), node, home, "captured", source)


def capture_by(df: DataFrame, node: str, home: str, key: str, fractions: Mapping, *, seed: int = 17, source: str | None = None) -> DataFrame:
    """Keep a share of each value of ``key``, so that rare values are in the sample as well."""
    return _record(df.sampleBy(key, dict(fractions), seed), node, home, "stratified", source)


def manifest(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{home}/manifest")


def load(spark: SparkSession, home: str, node: str, schema) -> DataFrame:
    """The kept rows of one node, under the source's schema."""
    return spark.read.schema(schema).json(f"{home}/samples/{node}")
