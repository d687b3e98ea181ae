"""Batch reads that skip files consumed before.

The state is a table of ``(path, modified_at, size, batch)`` rows. A file counts as consumed when its path and
modification time are both in the state, so a rewritten file is read again. Nothing is recorded until
``Increment.commit`` is called, which belongs after the write that used the rows: a run that fails in between
reads the same files once more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_SCHEMA = "path string, modified_at timestamp, size bigint, batch string"


@dataclass(frozen=True)
class Increment:
    """Rows of the files not read before, and the call that marks those files as consumed."""

    frame: DataFrame
    files: DataFrame
    commit: Callable[[], None]


@dataclass(frozen=True)
class Bookmark:
    """Consumed files of one source, kept under ``state_path``."""

    spark: SparkSession
    state_path: str

    def consumed(self) -> DataFrame:
        # An empty first entry, written once, so that the table can always be read.
        self.spark.createDataFrame([], STATE_SCHEMA).write.mode("ignore").parquet(f"{self.state_path}/consumed/none")
        reader = self.spark.read.schema(STATE_SCHEMA).option("recursiveFileLookup", True)
        return reader.parquet(f"{self.state_path}/consumed")

    def listing(self, paths: list[str], pattern: str = "*") -> DataFrame:
        """One row per file; only names, times and sizes are looked at, never the content."""
        return (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .load(paths)
            .select(
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_modification_time").alias("modified_at"),
                F.col("_metadata.file_size").alias("size"),
            )
        )

    def read(self, paths: list[str], schema: T.StructType | str, fmt: str = "parquet", pattern: str = "*", **options: str) -> Increment:
        """New files of ``paths``. The schema is declared, so an increment without files still has its columns."""
        batch = uuid.uuid4().hex
        pending = f"{self.state_path}/pending/{batch}"
        fresh = self.listing(paths, pattern).join(self.consumed(), ["path", "modified_at"], "left_anti")
        fresh.withColumn("batch", F.lit(batch)).write.parquet(pending)
        files = self.spark.read.schema(STATE_SCHEMA).parquet(pending)
        # The scan leaves out all files older than the oldest new one; of the others, rows of files read before are taken out
        # by a join on the names, which so never pass through Python.
        oldest = files.agg(F.min("modified_at").cast("timestamp_ntz").cast("string")).first()[0]
        if oldest is None:
            frame = self.spark.createDataFrame([], schema)
        else:
            after = F.lit(oldest).cast("timestamp_ntz") - F.expr("INTERVAL 1 SECOND")
            bound = self.spark.range(1).select(F.date_format(after, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).first()[0]
            reader = self.spark.read.format(fmt).options(**options).schema(schema).option("recursiveFileLookup", True)
            scan = reader.option("pathGlobFilter", pattern).option("modifiedAfter", bound).load(paths)
            wanted = files.select(F.col("path").alias("_path"), F.col("modified_at").alias("_modified_at"))
            named = scan.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("_modified_at"))
            frame = named.join(wanted, ["_path", "_modified_at"], "left_semi").drop("_path", "_modified_at")

        def commit() -> None:
            files.write.mode("overwrite").parquet(f"{self.state_path}/consumed/{batch}")

        return Increment(frame, files, commit)

    def reset(self) -> None:
        """Forget everything: the next read sees every file again."""
        self.spark.createDataFrame([], STATE_SCHEMA).write.mode("overwrite").parquet(f"{self.state_path}/consumed")
