"""Ordered work over keys of any size.

A window over a key puts all of that key's rows in one task. Here rows go to ranges of key and order instead, so a hot
key is cut into many pieces; each piece is handled by itself and only one row per piece travels to connect it with the next.

The bounds of the ranges come from a sample and are written down, so a row's piece follows from the row alone: what is
summed up per piece before the shuffle, and what is shuffled, agree on it, also when a task runs again. The rows
themselves are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirworks.session import cut_lineage

PIECE = "_piece"
# Rows sampled per piece, and the most pieces.
SAMPLED, MOST_PIECES = 60, 1 << 17


def _struct(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(columns)])


def in_pieces(df: DataFrame, by: Sequence[str], pieces: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with the number of the range of ``by`` that each row falls in, and the number of ranges; no row is moved.

    The sample is at most about SAMPLED rows per range; its bounds are one written row.
    """
    n = min(MOST_PIECES, pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = _struct(by)
    share = min(1.0, SAMPLED * n / max(1, df.count()))
    sample = df.select(key.alias("key")).sample(share, 11).agg(F.sort_array(F.collect_set("key")).alias("seen"))
    step = F.size("seen") / n
    marks = F.transform(F.sequence(F.lit(1), F.lit(max(1, n - 1))), lambda k: F.get("seen", F.floor(k * step).cast("int")))
    bounds = cut_lineage(sample.select(F.array_distinct(F.filter(marks, lambda m: m.isNotNull())).alias("bounds")) if n > 1 else sample.select(F.slice("seen", 1, 0).alias("bounds")))
    listed = bounds.scalar()
    # Binary search: how many bounds are not above the key.
    out = df.withColumn(PIECE, F.lit(0))
    for power in reversed(range((n - 1).bit_length())):
        there = F.col(PIECE) + (1 << power)
        passed = (there <= F.size(listed)) & (F.get(listed, there - 1) <= key)
        out = out.withColumn(PIECE, F.when(passed, there).otherwise(F.col(PIECE)))
    return out, n


def numbered(df: DataFrame, order: Sequence[str], name: str = "id", pieces: int | None = None) -> DataFrame:
    """Rows numbered 1..n in ``order``, which must be a total order. Nulls come first."""
    cut, n = in_pieces(df, order, pieces)
    sizes = cut.groupBy(PIECE).agg(F.count(F.lit(1)).alias("_n"))
    # One row per piece.
    before = F.sum("_n").over(Window.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(PIECE, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(PIECE).orderBy(*[F.col(f"`{c}`") for c in order]))
    local = cut.repartitionById(n, F.col(PIECE)).withColumn("_inside", inside)
    joined = local.join(F.broadcast(offsets), PIECE)
    return joined.withColumn(name, F.col("_inside") + F.col("_before")).drop(PIECE, "_before", "_inside")


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str = "prev_", pieces: int | None = None
) -> DataFrame:
    """Each row with the given columns of the row before it in the same key (a lag that a hot key cannot stall).

    ``has_prev`` tells a first row from one whose predecessor holds NULLs. Null keys are one key; nulls come first.
    """
    by = [*keys, *order]
    cut, n = in_pieces(df, by, pieces)
    carried = _struct([*keys, *columns])
    along = Window.partitionBy(PIECE).orderBy(*[F.col(f"`{c}`") for c in by])
    local = cut.repartitionById(n, F.col(PIECE)).withColumn("_lag", F.lag(carried).over(along))
    # The last row of every piece stands before the first of the next; one row per piece.
    tails = cut.groupBy(PIECE).agg(F.max_by(carried, _struct(by)).alias("_tail"))
    heads = tails.select(PIECE, F.lag("_tail").over(Window.orderBy(PIECE)).alias("_head"))
    out = local.join(F.broadcast(heads), PIECE, "left").withColumn("_prev", F.coalesce("_lag", "_head"))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_prev.c{k}")) for k, c in enumerate(keys)]
    has = reduce(lambda a, b: a & b, same, F.col("_prev").isNotNull())
    found = [F.when(has, F.col(f"_prev.c{len(keys) + k}")).alias(prefix + c) for k, c in enumerate(columns)]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *found, has.alias("has_prev"))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key.

    The filter on ``row_number`` becomes a group limit ahead of the shuffle, so each task sends at most ``n``
    rows of a key however many it holds. Beyond the size Spark does this for, the rows of each input partition
    are ranked and cut first, to the same effect.
    """
    name = rank or "_rank"
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        by_part = Window.partitionBy(*keys, "_part").orderBy(*order)
        parts = df.withColumn("_part", F.spark_partition_id()).withColumn("_first", F.row_number().over(by_part))
        df = parts.where(F.col("_first") <= n).drop("_part", "_first")
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)
