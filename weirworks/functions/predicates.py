"""Filter conditions with two-valued logic that still reach the scan.

A condition is never NULL for the caller: a comparison with a missing value is false, and its negation is
true. ``df.filter`` already drops rows where a plain comparison is NULL, so a condition that is not negated
stays a bare comparison, which parquet can take as a pushed filter; only negated ones are wrapped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.functions.names import field, type_of


@dataclass(frozen=True)
class Ref:
    """The other side of a condition when it is a column."""

    path: str


@dataclass(frozen=True)
class Condition:
    path: str
    op: str
    values: tuple[Any, ...] = ()
    negated: bool = False


def cond(path: str, op: str, *values: Any, negated: bool = False) -> Condition:
    """``cond("price", "BETWEEN", 1, 9)``; one list argument is accepted in place of several values."""
    flat: list[Any] = []
    for value in values:
        flat.extend(value) if isinstance(value, (list, tuple, set)) else flat.append(value)
    return Condition(path, op.upper(), tuple(flat), negated)


def predicate(df: DataFrame, conditions: Sequence[Condition], combine: str = "AND") -> Column:
    """All conditions joined by AND or OR. No conditions keep every row."""
    if combine.upper() not in ("AND", "OR"):
        raise ValueError(f"combine must be AND or OR, not {combine!r}")
    if not conditions:
        return F.lit(True)
    leaves = [leaf(df, c) for c in conditions]
    return reduce((lambda a, b: a | b) if combine.upper() == "OR" else (lambda a, b: a & b), leaves)


def leaf(df: DataFrame, c: Condition) -> Column:
    test = _test(df, c)
    return ~F.coalesce(test, F.lit(False)) if c.negated else test


def _test(df: DataFrame, c: Condition) -> Column:
    x = field(df, c.path)
    dtype = type_of(df, c.path)
    if c.op in ("NULL", "ISNULL"):
        return x.isNull()
    if c.op == "NOT_NULL":
        return x.isNotNull()
    text = x if isinstance(dtype, T.StringType) else x.cast("string")
    if c.op == "ZERO_LENGTH":
        return F.length(text) == 0
    if not c.values:
        raise ValueError(f"{c.op} on {c.path} needs a value")
    if c.op in ("EQ", "NE"):
        same = _same(df, x, dtype, c.values[0])
        return same if c.op == "EQ" else ~same
    if c.op == "IN":
        return _isin(df, x, dtype, c.values)
    if c.op in ("LT", "LTE", "GT", "GTE"):
        left, right = _ordered(df, x, dtype, c.values[0])
        return {"LT": left < right, "LTE": left <= right, "GT": left > right, "GTE": left >= right}[c.op]
    if c.op == "BETWEEN":
        low_x, low = _ordered(df, x, dtype, c.values[0])
        high_x, high = _ordered(df, x, dtype, c.values[-1])
        return (low_x >= low) & (high_x <= high)
    y = _operand_text(df, c.values[0])
    if c.op == "CONTAINS":
        return text.contains(y)
    if c.op == "STARTS_WITH":
        return text.startswith(y)
    if c.op == "ENDS_WITH":
        return text.endswith(y)
    if c.op == "REGEX":
        return F.regexp_like(text, y)
    if c.op in ("LIKE", "ILIKE"):
        if isinstance(c.values[0], Ref):
            return F.ilike(text, y) if c.op == "ILIKE" else F.like(text, y)
        # A backslash in the pattern is an ordinary character, so it must not escape the next one.
        pattern = str(c.values[0]).replace("\\", "\\\\")
        return text.ilike(pattern) if c.op == "ILIKE" else text.like(pattern)
    raise ValueError(f"unknown filter operation {c.op!r}")


def _operand_text(df: DataFrame, value: Any) -> Column:
    return field(df, value.path).cast("string") if isinstance(value, Ref) else F.lit(str(value))


def _constant(dtype: T.DataType, value: Any) -> Column | None:
    """``value`` as a literal of the column's type, or None when it is no value of that type."""
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    if isinstance(dtype, T.BooleanType):
        word = str(value).strip().lower()
        return F.lit(word == "true") if word in ("true", "false") else None
    if isinstance(dtype, T.NumericType):
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            try:
                return F.lit(float(value))
            except (TypeError, ValueError):
                return None
        try:
            # Through text, so that a decimal column sees the digits that were written.
            number = Decimal(str(value).strip())
        except InvalidOperation:
            return None
        if not number.is_finite():
            return F.lit(float(number))
        whole = number == number.to_integral_value()
        if isinstance(dtype, T.IntegralType):
            # 2.5 against an int column must not be cut to 2.
            return F.lit(int(number)) if whole and abs(number) < 2**63 else F.lit(float(number))
        digits = number.as_tuple()
        fits = len(digits.digits) <= 38 and -38 <= digits.exponent <= 0
        return F.lit(number) if fits else F.lit(int(number)) if whole and abs(number) < 2**63 else F.lit(float(number))
    if isinstance(value, str):
        return F.lit(value).cast(dtype)
    return F.lit(value)


def _same(df: DataFrame, x: Column, dtype: T.DataType, value: Any) -> Column:
    if isinstance(value, Ref):
        y = field(df, value.path)
        if type_of(df, value.path) != dtype and isinstance(dtype, T.StringType) != isinstance(
            type_of(df, value.path), T.StringType
        ):
            return x.cast("string").eqNullSafe(y.cast("string"))
        return x.eqNullSafe(y)
    if value is None:
        return x.isNull()
    y = _constant(dtype, value)
    return x.cast("string").eqNullSafe(str(value)) if y is None else x.eqNullSafe(y)


def _isin(df: DataFrame, x: Column, dtype: T.DataType, values: Sequence[Any]) -> Column:
    constants = [v for v in values if not isinstance(v, Ref) and v is not None]
    literals = [_constant(dtype, v) for v in constants]
    fitting = [c for c in literals if c is not None]
    tests = [x.isin(fitting)] if fitting else []
    tests += [_same(df, x, dtype, v) for v in values if isinstance(v, Ref) or v is None]
    if not tests:
        return F.lit(False)
    return reduce(lambda a, b: a | b, tests)


def _ordered(df: DataFrame, x: Column, dtype: T.DataType, value: Any) -> tuple[Column, Column]:
    if isinstance(value, Ref):
        other = type_of(df, value.path)
        y = field(df, value.path)
        if isinstance(dtype, T.StringType) and not isinstance(other, T.StringType):
            return x.try_cast(other), y
        if isinstance(other, T.StringType) and not isinstance(dtype, T.StringType):
            return x, y.try_cast(dtype)
        return x, y
    y = _constant(dtype, value)
    if y is None:
        raise ValueError(f"cannot order a {dtype.simpleString()} column against {value!r}")
    return x, y
