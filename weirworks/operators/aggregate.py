"""Grouping, deduplication and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.functions.names import field
from weirworks.operators.ordered import top_per_key

# Aggregate function names a grouping step may use.
FUNCTIONS = (
    "avg", "sum", "min", "max", "count", "countDistinct", "sumDistinct", "first", "last",
    "stddev_samp", "stddev_pop", "var_samp", "var_pop", "skewness", "kurtosis",
)


def aggregate(
    df: DataFrame,
    groups: Sequence[str] = (),
    aggs: Sequence[tuple[str, str]] = (),
    *,
    order: Sequence[str] = (),
) -> DataFrame:
    """Group by the listed fields; each ``(column, function)`` becomes a column ``<column>_<function>``.

    No functions gives a row count, no groups one overall row. ``first`` and ``last`` follow ``order`` when it
    is given, which makes them repeatable.
    """
    columns = [_call(df, column, fn, order).alias(f"{column}_{fn}") for column, fn in aggs]
    if not columns:
        columns = [F.count(F.lit(1)).alias("count")]
    return df.groupBy(*[field(df, g) for g in groups]).agg(*columns)


def _call(df: DataFrame, column: str, fn: str, order: Sequence[str]) -> Column:
    if fn not in FUNCTIONS and fn != "approxCountDistinct":
        raise ValueError(f"unknown aggregate {fn!r}; use one of {', '.join(FUNCTIONS)}")
    c = field(df, column)
    if fn in ("first", "last") and order:
        key = F.struct(*[field(df, o) for o in order])
        return F.min_by(c, key) if fn == "first" else F.max_by(c, key)
    plain = {
        "countDistinct": F.count_distinct,
        "sumDistinct": F.sum_distinct,
        "approxCountDistinct": F.approx_count_distinct,
    }
    return plain.get(fn, getattr(F, fn, None))(c)


def drop_duplicates(df: DataFrame, columns: Sequence[str] = (), *, order: Sequence[Column] = ()) -> DataFrame:
    """One row per distinct value of ``columns`` (all when empty); ``order`` says which row stays."""
    if not order:
        return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()
    return top_per_key(df, list(columns) or df.columns, order, 1)


def union(frames: Sequence[DataFrame], *, distinct: bool = False, by_name: bool = False) -> DataFrame:
    """Rows of all frames, matched by position or by name."""
    out = reduce((lambda a, b: a.unionByName(b)) if by_name else (lambda a, b: a.union(b)), frames)
    return out.distinct() if distinct else out


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str] = ()) -> DataFrame:
    """Keys that were added, removed or, in one of the compared columns, modified. One full outer join; NULL keys are keys."""
    keys = list(keys)
    before = old.select(*keys, F.struct(*compare).alias("_old") if compare else F.lit(1).alias("_old"))
    after = new.select(*keys, F.struct(*compare).alias("_new") if compare else F.lit(1).alias("_new"))
    # A marker per side, since a compared struct is never NULL but the missing side is.
    names = [f"_k{i}" for i in range(len(keys))]
    after = after.withColumn("_in_new", F.lit(True)).withColumnsRenamed(dict(zip(keys, names, strict=True)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    both = before.withColumn("_in_old", F.lit(True)).join(after, same, "full")
    change = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    key = [F.when(F.col("_in_old"), F.col(k)).otherwise(F.col(n)).alias(k) for k, n in zip(keys, names, strict=True)]
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select(*key, "change")
