"""Streaming sources and the ways a stream is run."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# State on local disk instead of the heap, and sessions merged before the shuffle, so that a key with very
# many rows sends one row per session and task.
STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def source(
    spark: SparkSession,
    fmt: str = "parquet",
    *,
    schema: T.StructType | str | None = None,
    path: str | None = None,
    options: Mapping[str, str] | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream from files, or from any streaming format on the classpath (Kafka, Kinesis) by its name."""
    for key, value in STATEFUL.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    reader = spark.readStream.format(fmt).options(**dict(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path) if path else reader.load()


def timed(df: DataFrame, column: str, delay: str) -> DataFrame:
    """The stream with a watermark. Times without a zone are taken as UTC, since watermarks need an instant."""
    cast = df if isinstance(df.schema[column].dataType, T.TimestampType) else df.withColumn(column, F.col(column).cast("timestamp"))
    return cast.withWatermark(column, delay)


def load_new(df: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet", partition_keys=()) -> None:
    """Everything that is new since the last call, in as many batches as it takes, added to ``path``.

    The checkpoint remembers the files read; it moves on only after a batch has been written.
    """
    writer = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    if partition_keys:
        writer = writer.partitionBy(*partition_keys)
    writer.start(path).awaitTermination()


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Call ``handle`` with every new batch until nothing new is left."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode)
    writer.trigger(availableNow=True).start().awaitTermination()
