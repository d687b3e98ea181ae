"""Type names used in mappings and declared schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The accepted type names and the Spark type each one stands for.
TYPE_NAMES = {
    "string": "string",
    "long": "bigint",
    "bigint": "bigint",
    "int": "int",
    "integer": "int",
    "short": "smallint",
    "smallint": "smallint",
    "byte": "tinyint",
    "tinyint": "tinyint",
    "double": "double",
    "float": "float",
    "boolean": "boolean",
    "timestamp": "timestamp",
    "timestamp_ntz": "timestamp_ntz",
    "date": "date",
    "decimal": "decimal(38,18)",
    "binary": "binary",
}


def spark_type(name: str) -> T.DataType:
    """``long``, ``decimal(10,2)``, ``array<string>``, ``map<..>`` or ``struct<a:int>`` as a Spark type."""
    text = name.strip().lower()
    if text in ("choice", "array", "struct", "map"):
        raise ValueError(f"{name!r} is not concrete: name its element types, or resolve the choice first")
    return T.DataType.fromDDL(TYPE_NAMES.get(text, name.strip()))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    """A declared schema from ``(name, type name)`` pairs."""
    return T.StructType([T.StructField(name, spark_type(kind), True) for name, kind in columns])
