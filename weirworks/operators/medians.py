"""Exact medians per group by distributed selection.

No task sorts a group. A group with more than ``MOST`` values is narrowed in rounds: a sketch gives a grid of its values,
two grid values around the middle rank bound a range, and exact counts below, at, between and above them tell where the
middle falls. A round so leaves about a hundredth of the values, whatever their distribution; a value that very many rows
share ends the search. What is left of a group, at most ``MOST`` values, is counted per value, and running counts give the
values at the middle ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.session import cut_lineage

MOST = 100_000
# Cells of the grid, cells added on both sides against the sketch's error, and that error's inverse.
CELLS, MARGIN, ACCURACY = 256, 1, 10_000


def _same(a: str, b: str, by: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.lit(True))


def _ranges(rows: DataFrame, by: list[str], large: DataFrame) -> DataFrame:
    """For each group of ``large`` (by, n) a range of at most MOST values that holds both middle ranks.

    Result: by, n, low, high, skip (the number of values below the range) and ``given``: low and high are the middle
    values themselves.
    """
    keys = [F.col(f"r.{c}").alias(c) for c in by]
    middle = [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)]
    start = rows.alias("r").join(large.alias("g"), _same("r", "g", by)).groupBy(*keys)
    start = start.agg(F.max("g.n").alias("n"), F.min("r.v").alias("low"), F.max("r.v").alias("high"), F.count("r.v").alias("inside"))
    open_ = cut_lineage(start.select(*by, "n", "low", "high", F.lit(0).cast("long").alias("skip"), "inside", F.lit(False).alias("few")))
    done, margin, grid = [], MARGIN, [n / CELLS for n in range(CELLS + 1)]
    while True:
        given = F.col("few") | (F.col("low") == F.col("high"))
        settled = given | (F.col("inside") <= MOST)
        done.append(open_.where(settled).select(*by, "n", "low", "high", "skip", given.alias("given")))
        open_ = open_.where(~settled)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        here = _same("r", "g", by) & (F.col("r.v") >= F.col("g.low")) & (F.col("r.v") <= F.col("g.high"))
        sketch = rows.alias("r").join(open_.alias("g"), here).groupBy(*keys).agg(F.percentile_approx("r.v", grid, ACCURACY).alias("grid"))
        cell = [F.floor((m - F.col("skip")) / F.col("inside") * CELLS).cast("int") for m in middle]
        tried = open_.alias("g").join(sketch.alias("r"), _same("g", "r", by)).select("g.*", "r.grid")
        first = F.coalesce(F.get("grid", cell[0] - margin), F.col("low")).alias("first")
        last = F.coalesce(F.get("grid", cell[1] + 1 + margin), F.col("high")).alias("last")
        tried = cut_lineage(tried.select(*open_.columns, first, last))

        v, first, last = F.col("r.v"), F.col("g.first"), F.col("g.last")
        between = (v > first) & (v < last)
        counts = rows.alias("r").join(tried.alias("g"), here).groupBy(*keys).agg(
            F.count_if(v < first).alias("below"),
            F.count_if(v == first).alias("at_first"),
            F.count_if(between).alias("between"),
            F.count_if((v == last) & (v > first)).alias("at_last"),
            F.min(F.when(between, v)).alias("least"),
            F.max(F.when(between, v)).alias("most"),
        )
        both = tried.alias("g").join(counts.alias("c"), _same("g", "c", by)).select("g.*", *[f"c.{c}" for c in counts.columns if c not in by])
        # Where the copies of ``first``, the values between and the copies of ``last`` begin and end.
        edges = [F.col("skip") + F.col("below")]
        for zone in ("at_first", "between", "at_last"):
            edges.append(edges[-1] + F.col(zone))
        inside = [(middle[0] >= edges[n]) & (middle[1] < edges[n + 1]) for n in range(3)]
        # The middle ranks are the last of one zone and the first of the next: two values are left.
        crossed = [(middle[0] < edges[n + 1]) & (middle[1] >= edges[n + 1]) & (middle[1] < edges[3]) & (middle[0] >= edges[0]) for n in range(2)]
        after_first = F.coalesce("least", "last")

        def pick(*values: Column, otherwise: str) -> Column:
            out = F.lit(None)
            for case, value in zip([*inside, *crossed], values, strict=True):
                out = F.when(case, value).otherwise(out)
            return F.coalesce(out, F.col(otherwise)).alias(otherwise)

        first, last = F.col("first"), F.col("last")
        before_last = F.coalesce("most", "first")
        open_ = cut_lineage(
            both.select(
                *by,
                "n",
                pick(first, F.col("least"), last, first, before_last, otherwise="low"),
                pick(first, F.col("most"), last, after_first, last, otherwise="high"),
                pick(edges[0], edges[1], edges[2], edges[0], edges[0], otherwise="skip"),
                pick(F.col("at_first"), F.col("between"), F.col("at_last"), F.col("inside"), F.col("inside"), otherwise="inside"),
                F.coalesce(crossed[0] | crossed[1], F.lit(False)).alias("few"),
                reduce(lambda a, b: a | b, [*inside, *crossed]).alias("held"),
            )
        )
        # Where the sketch missed the middle, the next round takes a wider range, at last the whole one.
        margin = MARGIN if open_.where("NOT held").isEmpty() else margin * 16
        open_ = open_.drop("held")


def medians(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """One row per group: the exact median of the numbers in ``column``, of an even number of values the mean of the middle two.

    Nulls and NaN take no part; a group without a value has none. The mean is computed as a decimal for whole numbers
    and decimals and comes back as a double or a decimal with one more digit.
    """
    by = list(by)
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    keys = [F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(by)]
    names = [f"k{n}" for n in range(len(by))]
    rows = df.select(*keys, value.alias("v")).where("v IS NOT NULL")
    sizes = rows.groupBy(*names).agg(F.count("v").alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > MOST))
    left = rows.select(*names, "v", F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("skip"))
    found = None
    if not large.isEmpty():
        found = cut_lineage(_ranges(rows, names, large))
        joined = rows.alias("r").join(found.alias("g"), _same("r", "g", names), "left")
        inside = F.col("g.n").isNull() | (~F.col("g.given") & (F.col("r.v") >= F.col("g.low")) & (F.col("r.v") <= F.col("g.high")))
        left = joined.where(inside).select(*[f"r.{c}" for c in names], "r.v", "g.n", F.coalesce("g.skip", F.lit(0).cast("long")).alias("skip"))
    counts = left.groupBy(*names, "v").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("skip").alias("skip"))
    # A group has at most MOST rows here.
    group = Window.partitionBy(*(names or [F.lit(1)]))
    n = F.coalesce(F.col("n"), F.sum("c").over(group))
    counts = counts.withColumn("upto", F.sum("c").over(group.orderBy("v")) + F.col("skip")).withColumn("n", n)
    low, high = (F.min(F.when(F.col("upto") > F.floor((F.col("n") - back) / 2), F.col("v"))) for back in (1, 0))
    out = counts.groupBy(*names).agg(low.alias("low"), high.alias("high"))
    if not names:
        out = out.where("low IS NOT NULL")
    if found is not None:
        out = out.unionByName(found.where("given").select(*names, "low", "high"))
    exact = kind if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)) else T.DecimalType(20, 0)
    if isinstance(exact, T.DecimalType):
        mean = ((F.col("low").cast(exact) + F.col("high").cast(exact)) / 2).cast(T.DecimalType(min(38, exact.precision + 2), min(exact.scale + 1, 37)))
        mean = mean if isinstance(kind, T.DecimalType) else mean.cast("double")
    else:
        mean = F.col("low").cast("double") / 2 + F.col("high").cast("double") / 2
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, by, strict=True)], mean.alias(name))
