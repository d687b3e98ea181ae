"""Places of rows within keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirworks.llm.common import partitions
from weirworks.session import cut_lineage

PIECE, AT = "_piece", "_at"


def in_order(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows written once in ``order`` (nulls first), with the range ``_piece`` each fell in and a number ``_at``.

    ``_at`` is unique and grows along the order, with gaps between ranges. A key with most of the rows is cut into many
    ranges; what is read later is always the same cut, also after an executor is lost.
    """
    by = [F.col(c) for c in order]
    cut = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    return cut_lineage(cut.withColumn(PIECE, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id()))


def placed(rows: DataFrame, key: str, order: Sequence[str], place: str = "place", size: str = "size") -> DataFrame:
    """The rows with their place (from 0) within ``key`` and the key's number of rows.

    ``key`` must not be null. Only one row per key and range is summed up to connect the ranges.
    """
    held = in_order(rows, [key, *order])
    parts = held.groupBy(key, PIECE).agg(F.min(AT).alias("_first"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(key).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(along), F.lit(0))
    parts = parts.select(key, PIECE, "_first", before.alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias(size))
    out = held.join(parts, [key, PIECE]).withColumn(place, F.col(AT) - F.col("_first") + F.col("_before"))
    return out.drop(PIECE, AT, "_first", "_before")


def never_null(value: Column) -> Column:
    """A text for the value that keeps null apart from every other and before it; texts keep their order by bytes."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))
