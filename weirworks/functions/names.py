"""Column-name helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snake(name: str) -> str:
    """``orderKey`` or ``Order-Key`` to ``order_key``."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^A-Za-z0-9]+", "_", spaced).strip("_").lower()


def quoted(path: str) -> str:
    """A dotted field path with every segment quoted."""
    return ".".join(f"`{part}`" for part in path.split("."))


def resolve_path(df: DataFrame, path: str) -> str:
    """The quoted form of ``path``; a top-level column whose own name has dots wins over nesting."""
    return f"`{path}`" if path in df.columns else quoted(path)


def field(df: DataFrame, path: str) -> Column:
    return F.col(resolve_path(df, path))


def type_of(df: DataFrame, path: str) -> T.DataType:
    if path in df.columns:
        return df.schema[path].dataType
    dtype: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            raise ValueError(f"no field {path!r} in {df.columns}")
        dtype = dtype[part].dataType
    return dtype
