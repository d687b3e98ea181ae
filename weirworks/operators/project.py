"""Projection and schema transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.functions.names import field, resolve_path, snake, type_of
from weirworks.operators.joins import join_unique
from weirworks.operators.medians import medians
from weirworks.operators.ordered import numbered
from weirworks.types import is_numeric, spark_type


@dataclass(frozen=True)
class FieldMap:
    source: str
    to: str | None = None
    to_type: str = "string"
    dropped: bool = False


def keep(source: str, to_type: str, to: str | None = None) -> FieldMap:
    return FieldMap(source, to, to_type)


def try_cast(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast that gives NULL for a value of the wrong form; types that cannot be cast at all still raise."""
    return column if source == target else column.try_cast(target)


def apply_mapping(df: DataFrame, mappings: Sequence[FieldMap]) -> DataFrame:
    """Keep only the listed fields, renamed and cast; a dotted target name builds a struct."""
    tree: dict[str, Any] = {}
    for m in mappings:
        if m.dropped:
            continue
        value = try_cast(field(df, m.source), type_of(df, m.source), spark_type(m.to_type))
        parts = (m.to or m.source).split(".")
        node = tree
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node[parts[-1]] = value
    return df.select(*[_build(v).alias(name) for name, v in tree.items()])


def _build(node: Any) -> Column:
    return F.struct(*[_build(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node


def select_fields(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    return df.select(*[field(df, p) for p in paths])


def drop_fields(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Drop columns, or fields inside a struct for dotted paths. Unknown paths are ignored."""
    nested: dict[str, list[str]] = {}
    plain = []
    for path in paths:
        head, _, rest = path.partition(".")
        if path in df.columns or not rest:
            plain.append(path)
        elif head in df.columns:
            nested.setdefault(head, []).append(rest)
    out = df.drop(*plain)
    return out.withColumns(
        {head: F.col(f"`{head}`").dropFields(*rest) for head, rest in nested.items() if head in out.columns}
    )


def rename_field(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rename a column, or move a nested field to a new path."""
    if source in df.columns and "." not in target:
        return df.withColumnRenamed(source, target)
    value = field(df, source)
    head, _, rest = target.partition(".")
    same_struct = source.partition(".")[0] == head and "." in source and bool(rest)
    if same_struct:
        moved = F.col(f"`{head}`").withField(rest, value).dropFields(source.partition(".")[2])
        return df.withColumn(head, moved)
    if not rest:
        return drop_fields(df.withColumn(target, value), [source])
    if head in df.columns:
        placed = F.col(f"`{head}`").withField(rest, value)
    else:
        placed = reduce(lambda inner, name: F.struct(inner.alias(name)), reversed(rest.split(".")), value)
    return drop_fields(df.withColumn(head, placed), [source])


def snake_case(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def drop_null_fields(
    df: DataFrame,
    *,
    empty_string: bool = False,
    null_string: bool = False,
    minus_one: bool = False,
    custom: Sequence[tuple[Any, str]] = (),
) -> DataFrame:
    """Drop the columns in which every value is NULL or one of the chosen stand-ins for NULL.

    One aggregation over all columns, run while the plan is made; each task sends one row. A frame without rows says
    nothing about its columns and keeps them all.
    """
    present = [
        F.max(_holds_value(F.col(f"`{f.name}`"), f.dataType, empty_string, null_string, minus_one, custom)).alias(f"c{i}")
        for i, f in enumerate(df.schema.fields)
    ]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *present).first()
    if found["rows"] == 0:
        return df
    return df.select(*[F.col(f"`{name}`") for i, name in enumerate(df.columns) if found[f"c{i}"]])


def _holds_value(c: Column, dtype: T.DataType, empty: bool, null_text: bool, minus_one: bool, custom: Sequence[tuple[Any, str]]) -> Column:
    stand_ins: list[Column] = []
    if isinstance(dtype, T.StringType):
        stand_ins += [c == ""] if empty else []
        stand_ins += [c == "null"] if null_text else []
    if isinstance(dtype, T.IntegralType) and minus_one:
        stand_ins.append(c == -1)
    for value, kind in custom:
        target = spark_type(kind)
        if target == dtype or (is_numeric(target) and is_numeric(dtype)):
            stand_ins.append(c == F.lit(value))
    tests = [c.isNotNull()] + [~s for s in stand_ins]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def split_fields(df: DataFrame, paths: Sequence[str], names: tuple[str, str] = ("selected", "rest")) -> dict[str, DataFrame]:
    return {names[0]: select_fields(df, paths), names[1]: drop_fields(df, paths)}


def select_from_collection(frames: Mapping[str, DataFrame], index: int = 0) -> DataFrame:
    return list(frames.values())[index]


def fill_missing(
    df: DataFrame, column: str, *, filled: str | None = None, by: Sequence[str] = (), method: str | None = None
) -> DataFrame:
    """Fill NULLs with the mean or median of a numeric column or the mode of any other, overall or per group.

    The median is exact (``medians``); ``approx_median`` is a sketch within a ten-thousandth of the rows of it, in a
    single aggregation. The statistic has one row per group and joins back on the group; it takes the column's type.
    """
    dtype = df.schema[column].dataType
    method = method or ("mean" if is_numeric(dtype) else "mode")
    value = F.col(column)
    if method == "mode":
        return _fill_mode(df, column, filled or column, list(by))
    if not is_numeric(dtype):
        raise ValueError(f"{method} needs a numeric column, {column} is {dtype.simpleString()}")
    if method == "median":
        exact = medians(df, column, by, "_fill")
        stats = exact.select(*[F.col(f"`{c}`") for c in by], F.col("_fill").try_cast(dtype).alias("_fill"))
        return _filled(df, stats, list(by), column, filled or column)
    statistic = {"mean": F.avg(value), "approx_median": F.percentile_approx(value, 0.5, 10000)}[method]
    stats = df.groupBy(*by).agg(statistic.try_cast(dtype).alias("_fill"))
    return _filled(df, stats, list(by), column, filled or column)


def _fill_mode(df: DataFrame, column: str, filled: str, by: list[str]) -> DataFrame:
    # Counting values first keeps the second aggregation at one row per distinct value.
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    # Among equally frequent values the smallest wins.
    first = F.min_by(column, F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))
    stats = counts.groupBy(*by).agg(first.alias("_fill"))
    return _filled(df, stats, by, column, filled)


def _filled(df: DataFrame, stats: DataFrame, by: list[str], column: str, filled: str) -> DataFrame:
    value = F.coalesce(F.col(column), F.col("_fill")).alias(filled)
    # Without groups the statistic is a global aggregate of one row.
    joined = join_unique(df, stats, by) if by else df.join(F.broadcast(stats), how="left")
    if filled == column:
        return joined.select(*[value if c == column else F.col(f"`{c}`") for c in df.columns])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], value)


def flatten(df: DataFrame, *, sep: str = "_", arrays: bool = False) -> DataFrame:
    """Every struct field as a column of its own; with ``arrays`` also one row per array element."""
    while True:
        structs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType)]
        lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)] if arrays else []
        if lists:
            name = lists[0]
            df = df.select(*[F.explode_outer(f"`{c}`").alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])
            continue
        if not structs:
            return df
        columns: list[Column] = []
        for f in df.schema.fields:
            if f.name in structs:
                columns += [F.col(f"`{f.name}`.`{g}`").alias(f"{f.name}{sep}{g}") for g in f.dataType.names]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(*columns)


def add_uuid(df: DataFrame, name: str = "uuid") -> DataFrame:
    return df.withColumn(name, F.uuid())


def add_identifier(df: DataFrame, name: str = "id", order_by: Sequence[str] = ()) -> DataFrame:
    """A number per row: unique and increasing within a partition, or 1..n in the given order.

    The ordered form sorts by range and adds each partition's row count to the next ones, so no task sees
    more than its own range.
    """
    if not order_by:
        return df.withColumn(name, F.monotonically_increasing_id())
    return numbered(df, order_by, name)


def to_timestamp(df: DataFrame, column: str, fmt: str, to: str | None = None) -> DataFrame:
    """Text to timestamp; text of another form becomes NULL."""
    return df.withColumn(to or column, F.try_to_timestamp(F.col(column), F.lit(fmt)))


def format_timestamp(df: DataFrame, column: str, fmt: str, to: str | None = None) -> DataFrame:
    return df.withColumn(to or column, F.date_format(column, fmt))


def concatenate(df: DataFrame, columns: Sequence[str], to: str, sep: str = "") -> DataFrame:
    """Text of several columns joined by ``sep``; NULLs are left out."""
    return df.withColumn(to, F.concat_ws(sep, *[F.col(resolve_path(df, c)).cast("string") for c in columns]))


def split_string(df: DataFrame, column: str, pattern: str, to: str | None = None, limit: int = -1) -> DataFrame:
    return df.withColumn(to or column, F.split(column, pattern, limit))


def resolve_choice(df: DataFrame, column: str, *, cast: str | None = None, make_columns: Sequence[str] = ()) -> DataFrame:
    """Settle a column of mixed content: cast it to one type, or give each type a column of its own."""
    c = F.col(f"`{column}`")
    if (cast is None) == (not make_columns):
        raise ValueError("give either cast or make_columns")
    if cast:
        return df.withColumn(column, c.try_cast(spark_type(cast)))
    made: dict[str, Column] = {}
    taken: Column | None = None
    for kind in make_columns:
        typed = c.try_cast(spark_type(kind))
        # The first type that fits owns the value; later columns stay NULL for that row.
        made[f"{column}_{kind}"] = typed if taken is None else F.when(taken, None).otherwise(typed)
        taken = typed.isNotNull() if taken is None else taken | typed.isNotNull()
    return df.withColumns(made).drop(column)


def schema_record(df: DataFrame) -> DataFrame:
    """Rows ``(name, type, non_null)``: every column with its type and how many values it holds, in one pass."""
    kinds = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema.fields])
    counts = F.array(*[F.count(F.col(f"`{c}`")) for c in df.columns])
    zipped = df.agg(F.arrays_zip(kinds.alias("kind"), counts.alias("non_null")).alias("columns"))
    return zipped.select(F.inline("columns")).select("kind.*", "non_null")


def schema_drift(df: DataFrame, declared: T.StructType) -> DataFrame:
    """Rows ``(name, problem, declared, actual, non_null)`` for missing, extra and retyped columns.

    ``non_null`` is how many values the actual column holds, which is what the drift puts at risk.
    """
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wanted = {f.name: f.dataType.simpleString() for f in declared.fields}
    found = [(n, "missing", t, None) for n, t in wanted.items() if n not in actual]
    found += [(n, "extra", None, t) for n, t in actual.items() if n not in wanted]
    found += [(n, "type", t, actual[n]) for n, t in wanted.items() if n in actual and actual[n] != t]
    drift = df.sparkSession.createDataFrame(found, "name string, problem string, declared string, actual string")
    touched = [n for n, problem, _, _ in found if problem != "missing"]
    if not touched:
        return drift.withColumn("non_null", F.lit(0).cast("bigint"))
    counts = schema_record(df.select(*[F.col(f"`{c}`") for c in touched])).select("name", "non_null")
    return drift.join(counts, "name", "left").fillna(0, ["non_null"])
