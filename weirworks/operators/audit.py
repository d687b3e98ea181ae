"""Checks on tables and pipelines: lost columns and values, join health, skew, previews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.session import cut_lineage
from weirworks.types import spark_type


def preview(df: DataFrame, rows: int = 50, order: Sequence[str] = ()) -> DataFrame:
    """The first rows (1 to 500); with an order, the same ones every time."""
    if not 1 <= rows <= 500:
        raise ValueError("a preview shows 1 to 500 rows")
    return (df.orderBy(*order) if order else df).limit(rows)


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def key_histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key with the key's share of all rows. The first aggregation leaves one row per key."""
    counts = df.groupBy(*_columns(keys)).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("_all"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("rows") / F.col("_all")).drop("_all")


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.05) -> DataFrame:
    """Keys that hold at least ``share`` of the rows; there are never more than ``1 / share`` of them."""
    if not 0 < share <= 1:
        raise ValueError("share is a fraction above 0")
    return key_histogram(df, keys).where(F.col("share") >= share)


# Items that the sketch of heavy keys tracks, and candidates that are counted exactly.
TRACKED, CANDIDATES = 50_000, 1_000


def heavy_keys(df: DataFrame, keys: Sequence[str], candidates: int = CANDIDATES, tracked: int = TRACKED) -> tuple[DataFrame, int]:
    """Exact counts of the keys that a mergeable sketch finds heaviest, and what any other key has at most.

    The sketch keeps at most ``tracked`` keys per task, whatever the number of keys, and only sketches are shuffled. Its counts
    are off by at most 3.5 in ``tracked`` rows, and it gives out keys that it knows to have more than that, so a key that
    is not given out has at most twice as many, or the estimate of the last of the ``candidates``. These, few enough to
    broadcast, are counted in a second pass.
    """
    name = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    named = df.withColumn("_key", name)
    sketch = named.agg(F.expr(f"approx_top_k(_key, {candidates}, {tracked})").alias("top"), F.count(F.lit(1)).alias("rows")).first()
    top = sketch["top"] or []
    whole = sum(r["count"] for r in top) == sketch["rows"]
    lost = 0 if whole else max(int(7 * sketch["rows"] / tracked) + 1, top[-1]["count"] if len(top) == candidates else 0)
    listed = df.sparkSession.createDataFrame([(r["item"],) for r in top], "_key string")
    found = named.join(F.broadcast(listed), "_key").groupBy(*_columns(keys)).agg(F.count(F.lit(1)).alias("rows"))
    return found.withColumn("share", F.col("rows") / F.lit(sketch["rows"])), lost


def skew_report(df: DataFrame, keys: Sequence[str], top: int = 10) -> DataFrame:
    """The ``top`` heaviest keys, ties to the smaller key, with exact counts.

    They come from a sketch whose candidates are counted. Where keys are so even that a lost one could belong to the
    report, all keys are counted.
    """
    found, lost = heavy_keys(df, keys, max(CANDIDATES, 4 * top))
    found = cut_lineage(found.orderBy(F.desc("rows"), *_columns(keys)).limit(top))
    least = found.agg(F.min("rows"), F.count(F.lit(1))).first()
    if lost and (least[1] < top or least[0] <= lost):
        return key_histogram(df, keys).orderBy(F.desc("rows"), *_columns(keys)).limit(top)
    return found.orderBy(F.desc("rows"), *_columns(keys))


def cast_loss(df: DataFrame, casts: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``(column, to_type, values, lost)``: how many values a cast would turn into NULL. One pass."""
    cells = []
    for column, kind in casts:
        c = F.col(f"`{column}`")
        bad = c.isNotNull() & c.try_cast(spark_type(kind)).isNull()
        cells.append(
            F.struct(F.lit(column).alias("column"), F.lit(kind).alias("to_type"), F.count(c).alias("values"), F.count_if(bad).alias("lost"))
        )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def join_health(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """One row: left and right sizes, NULL keys, matched rows, keys repeated on the right and joined size.

    Both sides shrink to one row per key before they meet.
    """
    names = [f"k{i}" for i in range(len(left_keys))]
    l_counts = left.groupBy(*[F.col(c).alias(n) for c, n in zip(left_keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("l"))
    r_counts = right.groupBy(*[F.col(c).alias(n) for c, n in zip(right_keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("r"))
    both = l_counts.join(r_counts, names, "full")
    null_key = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    l_rows, r_rows = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    matched = F.col("l").isNotNull() & F.col("r").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        total(l_rows).alias("left_rows"),
        total(r_rows).alias("right_rows"),
        total(F.when(null_key, l_rows)).alias("left_null_keys"),
        total(F.when(matched, l_rows)).alias("left_matched"),
        total(F.when(~matched, l_rows)).alias("left_unmatched"),
        F.count_if(r_rows > 1).alias("right_repeated_keys"),
        total(F.when(matched, l_rows * r_rows)).alias("joined_rows"),
    )


def column_loss(produced: DataFrame, kept: DataFrame) -> DataFrame:
    """Columns that reach a node but are not among the ones it keeps, over ``(node, column)`` tables.

    One aggregation over both tables, so a pair that is there very often is summed up before it moves. A null is kept by nothing.
    """
    whole = F.col("node").isNotNull() & F.col("column").isNotNull()
    both = produced.select("node", "column", F.lit(False).alias("kept")).unionByName(kept.select("node", "column", whole.alias("kept")).where("kept"))
    pairs = both.groupBy("node", "column").agg(F.max("kept").alias("kept"))
    return pairs.where("NOT kept").select("node", "column")


def missing_references(available: DataFrame, referenced: DataFrame) -> DataFrame:
    """Columns a node refers to that do not reach it."""
    return column_loss(referenced, available)


def colliding_columns(inputs: DataFrame) -> DataFrame:
    """Column names that reach a node from more than one input, over ``(node, input, column)``."""
    counts = inputs.select("node", "input", "column").distinct().groupBy("node", "column").agg(F.count(F.lit(1)).alias("inputs"))
    return counts.where("inputs > 1")


def observed_counts(frames: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, Observation]]:
    """Frames that count their own rows while something else reads them: no cache and no extra job.

    The counts are ready in ``observation.get`` once an action has run.
    """
    watched, seen = {}, {}
    for name, df in frames.items():
        seen[name] = Observation(f"{name}-counts")
        watched[name] = df.observe(seen[name], F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))
    return watched, seen


def synthetic_rows(
    schema: T.StructType, n: int, spark: SparkSession, *, hints: Mapping[str, object] | None = None, casts: Mapping[str, str] | None = None,
    numbers: DataFrame | None = None,
) -> DataFrame:
    """``n`` rows made from a schema, or one per row of ``numbers`` (a frame with a positive ``i`` column).

    A hint fixes the value of a column that is not numeric. ``casts`` names the type a text column will be
    cast to later, so its text has that form. Arrays have two elements, maps one entry, structs all their fields.
    """
    base = numbers if numbers is not None else spark.range(1, n + 1).withColumnRenamed("id", "i")
    i = F.col("i")
    columns = []
    for f in schema.fields:
        later = (casts or {}).get(f.name)
        shape = spark_type(later) if later and isinstance(f.dataType, T.StringType) else f.dataType
        if hints and f.name in hints and not isinstance(shape, T.NumericType):
            value = F.lit(hints[f.name])
        else:
            value = _made_value(f.name, shape, i)
        columns.append(value.cast(f.dataType).alias(f.name))
    return base.select(*columns)


def _made_value(name: str, dtype: T.DataType, i: Column) -> Column:
    if isinstance(dtype, T.IntegralType):
        return i
    if isinstance(dtype, T.NumericType):
        return i.cast("decimal(20,1)") + F.lit(0.5).cast("decimal(2,1)")
    if isinstance(dtype, T.BooleanType):
        return i % 2 == 0
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        day = F.format_string("2024-01-%02d", 1 + i % 28)
        return day if isinstance(dtype, T.DateType) else F.concat(day, F.lit(" 12:00:00"))
    if isinstance(dtype, T.StructType):
        return F.struct(*[_made_value(f.name, f.dataType, i).cast(f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        one = _made_value(name, dtype.elementType, i).cast(dtype.elementType)
        return F.array(one, one)
    if isinstance(dtype, T.MapType):
        return F.create_map(_made_value("key", dtype.keyType, i).cast(dtype.keyType), _made_value("value", dtype.valueType, i).cast(dtype.valueType))
    return F.concat(F.lit(f"{name}-"), i.cast("string"))
