"""SQL steps, user functions and parameterised transforms."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.operators import project
from weirworks.operators.joins import lookup


def sql_transform(
    spark: SparkSession, query: str, inputs: Mapping[str, DataFrame], aliases: Mapping[str, str] | None = None
) -> DataFrame:
    """Run a query over named frames. ``aliases`` maps input name to view name; by default they are equal.

    The result is analysed at once, so registering the same view name later does not change it.
    """
    aliases = dict(aliases or {name: name for name in inputs})
    unknown = [name for name in aliases if name not in inputs]
    if unknown:
        raise ValueError(f"aliases name {unknown}, which are not inputs")
    for name, alias in aliases.items():
        inputs[name].createOrReplaceTempView(alias)
    return spark.sql(query)


def custom_code(
    fn: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]], inputs: Mapping[str, DataFrame], output: str | None = None
) -> DataFrame:
    """Call a function from named frames to named frames; the first frame it returns is the result."""
    frames = fn(dict(inputs))
    if not frames:
        raise ValueError("the custom step returned no frame")
    return frames[output] if output else next(iter(frames.values()))


def register_function(spark: SparkSession, name: str, fn: Callable, returns: str) -> None:
    """Make a function of pandas Series callable from SQL steps; rows reach it in Arrow batches."""
    spark.udf.register(name, F.pandas_udf(fn, returns))


def register_table_function(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """Make a class whose ``eval`` yields rows callable from SQL steps as a table function."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns, useArrow=True))


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str = "str"
    optional: bool = False
    rule: str | None = None
    message: str | None = None
    options: tuple[str, ...] = ()
    list_type: str | None = None

    def check(self, value: Any) -> Any:
        if self.type == "list":
            items = list(value)
            return [Parameter(self.name, self.list_type or "str", False, self.rule, self.message, self.options).check(v) for v in items]
        # Parameter types a transform may declare.
        kinds = {"str": str, "int": int, "float": (int, float), "bool": bool}
        if self.type not in kinds:
            raise ValueError(f"{self.name}: unknown parameter type {self.type!r}")
        if not isinstance(value, kinds[self.type]) or (self.type in ("int", "float") and isinstance(value, bool)):
            raise ValueError(f"{self.name}: {value!r} is not of type {self.type}")
        if self.options and value not in self.options:
            raise ValueError(f"{self.name}: {value!r} is not one of {', '.join(map(str, self.options))}")
        if self.rule and not re.fullmatch(self.rule, str(value)):
            raise ValueError(self.message or f"{self.name}: {value!r} does not match {self.rule}")
        return value


@dataclass(frozen=True)
class Transform:
    name: str
    function: Callable[..., DataFrame]
    parameters: tuple[Parameter, ...] = ()
    version: str = "1.0"
    display_name: str = ""


@dataclass
class TransformRegistry:
    """Named transforms with checked parameters."""

    transforms: dict[str, Transform] = field(default_factory=dict)

    def register(self, transform: Transform) -> None:
        self.transforms[transform.name] = transform

    def apply(self, name: str, df: DataFrame, **values: Any) -> DataFrame:
        if name not in self.transforms:
            raise ValueError(f"no transform {name!r}; known: {', '.join(sorted(self.transforms))}")
        transform = self.transforms[name]
        known = {p.name: p for p in transform.parameters}
        extra = [v for v in values if v not in known]
        missing = [p.name for p in transform.parameters if not p.optional and p.name not in values]
        if extra or missing:
            raise ValueError(f"{name}: unknown parameters {extra}, missing parameters {missing}")
        return transform.function(df, **{k: known[k].check(v) for k, v in values.items()})


def built_in_transforms() -> TransformRegistry:
    """The ready-made transforms: flatten, uuid, identifier, timestamps, concatenate, split, lookup, choice."""
    column = Parameter("column")
    to = Parameter("to", optional=True)
    listed = Parameter("columns", "list", list_type="str")
    registry = TransformRegistry()
    for t in (
        Transform("flatten", project.flatten, (Parameter("sep", optional=True), Parameter("arrays", "bool", True))),
        Transform("uuid", project.add_uuid, (Parameter("name", optional=True),)),
        Transform("identifier", project.add_identifier, (Parameter("name", optional=True), Parameter("order_by", "list", True, list_type="str"))),
        Transform("to_timestamp", project.to_timestamp, (column, Parameter("fmt"), to)),
        Transform("format_timestamp", project.format_timestamp, (column, Parameter("fmt"), to)),
        Transform("concatenate", project.concatenate, (listed, Parameter("to"), Parameter("sep", optional=True))),
        Transform("split_string", project.split_string, (column, Parameter("pattern"), to)),
        Transform("resolve_choice", project.resolve_choice, (column, Parameter("cast", optional=True), Parameter("make_columns", "list", True, list_type="str"))),
    ):
        registry.register(t)
    return registry


def lookup_transform(dim: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> Transform:
    """A registrable lookup into one dimension frame."""
    return Transform("lookup", lambda df: lookup(df, dim, keys, columns))
