"""Windowed counts, idle sessions and deduplication, the same in batch and in a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirworks.streaming.flow import timed


def window_counts(df: DataFrame, time: str, width: str, keys: Sequence[str] = (), *, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows per window and key; sliding when ``slide`` is given. Rows later than ``delay`` are left out of a stream."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = timed(df, time, delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def session_stream(df: DataFrame, keys: Sequence[str], time: str, gap: str, *, delay: str = "1 hour") -> DataFrame:
    """Sessions of a stream: a session ends when its key is idle for ``gap``."""
    grouped = timed(df, time, delay).groupBy(*keys, F.session_window(time, gap).alias("s"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("idle_at"), "n"
    )


def session_table(df: DataFrame, keys: Sequence[str], time: str, gap_seconds: int) -> DataFrame:
    """Sessions of a table.

    Rows of a key within one slot as wide as the gap always share a session, so a partial aggregation per slot
    comes first. What is left to order is one row per slot and key, however many rows a key has.
    """
    micros, gap = F.unix_micros(F.col(time).cast("timestamp")), gap_seconds * 1_000_000
    slots = df.groupBy(*keys, F.floor(micros / gap).alias("_slot")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    by_key = Window.partitionBy(*keys).orderBy("_slot")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(by_key) > gap, F.lit(True))
    numbered = slots.withColumn("_open", opens.cast("int")).withColumn("_no", F.sum("_open").over(by_key))
    out = numbered.groupBy(*keys, "_no").agg(F.min("_first").alias("_a"), F.max("_last").alias("_b"), F.sum("_n").alias("n"))
    return out.select(
        *keys, F.timestamp_micros("_a").alias("session_start"), F.timestamp_micros(F.col("_b") + gap).alias("idle_at"), "n"
    )


def drop_repeats(df: DataFrame, keys: Sequence[str], time: str, *, delay: str) -> DataFrame:
    """One row per key among rows at most ``delay`` apart."""
    return timed(df, time, delay).dropDuplicatesWithinWatermark(list(keys))
