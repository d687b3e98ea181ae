"""Row filters and the conditional router."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.functions.predicates import Condition, predicate


def filter_rows(df: DataFrame, conditions: Sequence[Condition], combine: str = "AND") -> DataFrame:
    return df.filter(predicate(df, conditions, combine)) if conditions else df


def route(
    df: DataFrame, groups: Mapping[str, tuple[str, Sequence[Condition]]], default: str = "default_group"
) -> dict[str, DataFrame]:
    """One frame per named group, plus the rows that belong to none. A row may belong to several groups.

    ``groups`` maps a name to ``(AND|OR, conditions)``. Every frame is its own filter, so each one still
    pushes down to the scan.
    """
    tests = {name: predicate(df, conditions, combine) for name, (combine, conditions) in groups.items()}
    frames = {name: df.filter(test) for name, test in tests.items()}
    anything = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests.values()], F.lit(False))
    frames[default] = df.filter(~anything)
    return frames
