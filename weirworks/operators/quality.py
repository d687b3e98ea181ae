"""Data-quality rules: every rule of a frame is measured in one aggregation."""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.operators.aggregate import union

# Comparison signs of a rule.
COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq, "!=": operator.ne}


@dataclass(frozen=True)
class Rule:
    """A rule kind with its columns and what its measure is compared with."""

    kind: str
    columns: tuple[str, ...] = ()
    op: str = ">"
    value: Any = 0
    values: tuple[Any, ...] = ()

    @property
    def text(self) -> str:
        names = " ".join(f'"{c}"' for c in self.columns)
        if self.kind in ("IsComplete", "IsUnique", "IsPrimaryKey", "ColumnExists"):
            return f"{self.kind} {names}"
        if self.kind == "ColumnValues" and self.op in ("in", "matches", "between"):
            shown = f'"{self.value}"' if self.op == "matches" else "[" + ", ".join(f'"{v}"' for v in self.values) + "]"
            return f"ColumnValues {names} {self.op} {shown}"
        return " ".join(p for p in (self.kind, names, self.op, str(self.value)) if p)


def row_count(op: str = ">", value: int = 0) -> Rule:
    return Rule("RowCount", (), op, value)


def is_complete(column: str) -> Rule:
    return Rule("IsComplete", (column,))


def completeness(column: str, op: str, value: float) -> Rule:
    return Rule("Completeness", (column,), op, value)


def is_unique(column: str) -> Rule:
    return Rule("IsUnique", (column,))


def uniqueness(column: str, op: str, value: float) -> Rule:
    return Rule("Uniqueness", (column,), op, value)


def distinct_count(column: str, op: str, value: int) -> Rule:
    return Rule("DistinctValuesCount", (column,), op, value)


def column_exists(column: str) -> Rule:
    return Rule("ColumnExists", (column,))


def values_in(column: str, *values: Any) -> Rule:
    return Rule("ColumnValues", (column,), "in", 0, values)


def values_between(column: str, low: Any, high: Any) -> Rule:
    return Rule("ColumnValues", (column,), "between", 0, (low, high))


def values_match(column: str, pattern: str) -> Rule:
    return Rule("ColumnValues", (column,), "matches", pattern)


def statistic(kind: str, column: str, op: str, value: float) -> Rule:
    if kind not in ("Mean", "Sum", "StandardDeviation"):
        raise ValueError(f"unknown statistic {kind!r}")
    return Rule(kind, (column,), op, value)


def parse_rules(text: str) -> list[Rule]:
    """The short text form: ``RowCount <sign> n``, ``IsComplete "c"`` and ``IsUnique "c"``, split by commas."""
    body = re.sub(r"^\s*Rules\s*=\s*\[|\]\s*$", "", text.strip())
    rules = []
    for part in (p.strip() for p in body.split(",")):
        if not part:
            continue
        counted = re.fullmatch(r"RowCount\s*(>=|<=|!=|>|<|=)\s*(\d+)", part)
        named = re.fullmatch(r'(IsComplete|IsUnique)\s+"([^"]+)"', part)
        if counted:
            rules.append(row_count(counted[1], int(counted[2])))
        elif named:
            rules.append(Rule(named[1], (named[2],)))
        else:
            raise ValueError(f"cannot read the rule {part!r}; give it as a Rule")
    return rules


def row_test(rule: Rule) -> Column | None:
    """The condition a single row has to meet, for rules that speak about rows."""
    if rule.kind == "IsComplete":
        return F.col(rule.columns[0]).isNotNull()
    if rule.kind == "ColumnValues":
        c = F.col(rule.columns[0])
        if rule.op == "in":
            test = c.isin(*rule.values)
        elif rule.op == "between":
            test = c.between(*rule.values)
        elif rule.op == "matches":
            test = F.regexp_like(c.cast("string"), F.lit(f"^(?:{rule.value})$"))
        else:
            test = COMPARE[rule.op](c, F.lit(rule.value))
        return F.coalesce(test, F.lit(False))
    return None


def _measure(rule: Rule) -> Column | None:
    """The rule's measure as an aggregate, or None when it needs the distribution of a column."""
    if rule.kind == "RowCount":
        return F.count(F.lit(1)).cast("double")
    if rule.kind in ("IsComplete", "Completeness"):
        share = F.count(F.col(rule.columns[0])) / F.nullif(F.count(F.lit(1)), F.lit(0))
        return F.coalesce(share, F.lit(1.0))
    if rule.kind == "ColumnValues":
        return F.coalesce(F.count_if(row_test(rule)) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0))
    if rule.kind == "Mean":
        return F.avg(rule.columns[0]).cast("double")
    if rule.kind == "Sum":
        return F.sum(rule.columns[0]).cast("double")
    if rule.kind == "StandardDeviation":
        return F.stddev_samp(rule.columns[0])
    return None


def _expected(rule: Rule) -> tuple[str, float]:
    if rule.kind in ("IsComplete", "IsUnique", "IsPrimaryKey", "ColumnExists", "ColumnValues"):
        return "=", 1.0
    return rule.op, float(rule.value)


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Outcomes ``(rule, metric, expected, passed)``, one row per rule.

    Rules about rows share one aggregation without a shuffle of rows. Uniqueness rules need the values counted
    first: one such grouping per column list, after map-side counting.
    """
    measures: dict[int, Column] = {}
    spread: dict[tuple[str, ...], list[int]] = {}
    for i, rule in enumerate(rules):
        if rule.kind == "ColumnExists":
            measures[i] = F.max(F.lit(1.0 if rule.columns[0] in df.columns else 0.0))
        elif rule.kind in ("IsUnique", "IsPrimaryKey", "Uniqueness", "DistinctValuesCount"):
            spread.setdefault(tuple(rule.columns), []).append(i)
        else:
            measure = _measure(rule)
            if measure is None:
                raise ValueError(f"unknown rule kind {rule.kind!r}")
            measures[i] = measure
    frames = []
    if measures:
        cells = [F.struct(F.lit(i).alias("no"), m.cast("double").alias("metric")) for i, m in measures.items()]
        frames.append(df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    for columns, numbers in spread.items():
        # All columns of a rule make up its value; it is known when none of them is NULL.
        names = [f"v{k}" for k in range(len(columns))]
        counts = df.groupBy(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]).agg(F.count(F.lit(1)).alias("n"))
        whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
        rows, known = F.sum("n"), F.count_if(whole)
        once = F.count_if((F.col("n") == 1) & whole)
        share = F.coalesce(once / F.nullif(rows, F.lit(0)), F.lit(1.0))
        cells = [
            F.struct(F.lit(i).alias("no"), (known if rules[i].kind == "DistinctValuesCount" else share).cast("double").alias("metric"))
            for i in numbers
        ]
        frames.append(counts.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    table = [(i, r.text, f"{_expected(r)[0]} {_expected(r)[1]:g}") for i, r in enumerate(rules)]
    named = df.sparkSession.createDataFrame(table, "no int, rule string, expected string")
    passed = reduce(
        lambda acc, i: F.when(F.col("no") == i, COMPARE[_expected(rules[i])[0]](F.col("metric"), F.lit(_expected(rules[i])[1]))).otherwise(acc),
        range(len(rules)), F.lit(False),
    )
    out = union(frames).join(F.broadcast(named), "no")
    return out.select("rule", "metric", "expected", F.coalesce(passed, F.lit(False)).alias("passed"))


def row_outcomes(df: DataFrame, rules: Sequence[Rule], to: str = "failed_rules") -> DataFrame:
    """Each row with the list of row rules it fails."""
    failed = [F.when(~row_test(r), F.lit(r.text)) for r in rules if row_test(r) is not None]
    if not failed:
        return df.withColumn(to, F.array().cast("array<string>"))
    return df.withColumn(to, F.filter(F.array(*failed), lambda m: m.isNotNull()))


def split_by_outcome(df: DataFrame, rules: Sequence[Rule]) -> dict[str, DataFrame]:
    marked = row_outcomes(df, rules)
    return {"passed": marked.where(F.size("failed_rules") == 0).drop("failed_rules"), "failed": marked.where(F.size("failed_rules") > 0)}


def referential_integrity(df: DataFrame, columns: Sequence[str], other: DataFrame, other_columns: Sequence[str]) -> DataFrame:
    """One row: how many rows point at a key the other frame has, and their share. NULL keys point nowhere.

    Both sides are counted per key before they meet.
    """
    names = [f"k{i}" for i in range(len(columns))]
    keyed = df.groupBy(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]).agg(F.count(F.lit(1)).alias("n"))
    known = other.select(*[F.col(c).alias(n) for c, n in zip(other_columns, names, strict=True)]).distinct().withColumn("_known", F.lit(True))
    both = keyed.join(known, names, "left")
    out = both.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("_known"), F.col("n"))), F.lit(0)).alias("matched"))
    return out.select(F.coalesce("rows", F.lit(0)).alias("rows"), "matched", F.coalesce(F.col("matched") / F.col("rows"), F.lit(1.0)).alias("ratio"))


def row_count_match(df: DataFrame, others: Mapping[str, DataFrame]) -> DataFrame:
    """``(alias, rows, other_rows, ratio)`` for each other frame."""
    mine = df.agg(F.count(F.lit(1)).alias("rows"))
    frames = [o.agg(F.lit(alias).alias("alias"), F.count(F.lit(1)).alias("other_rows")) for alias, o in others.items()]
    # Both sides are single aggregate rows.
    both = union(frames).join(F.broadcast(mine))
    return both.select("alias", "rows", "other_rows", (F.col("rows") / F.nullif("other_rows", F.lit(0))).alias("ratio"))


def dataset_match(df: DataFrame, other: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """One row: keys (rows), keys in common, keys whose compared columns agree, that share of all keys of ``df``, and
    how many rows repeat a key on either side.

    A key that is repeated counts once, with the smallest of its compared values. NULL keys are keys.
    """
    names = [f"_k{i}" for i in range(len(keys))]

    def once(frame: DataFrame, value: str, extra: str) -> DataFrame:
        named = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
        return frame.groupBy(*named).agg(F.min(F.struct(*compare)).alias(value), (F.count(F.lit(1)) - 1).alias(extra))

    a, b = once(df, "_a", "_more_a"), once(other, "_b", "_more_b").withColumnsRenamed({n: f"{n}_b" for n in names})
    same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"{n}_b")) for n in names])
    both = a.join(b, same, "full")
    mine, theirs = F.col("_more_a").isNotNull(), F.col("_more_b").isNotNull()
    out = both.agg(
        F.count_if(mine).alias("rows"), F.count_if(mine & theirs).alias("common"),
        F.count_if(mine & theirs & F.col("_a").eqNullSafe(F.col("_b"))).alias("equal"),
        F.coalesce(F.sum(F.coalesce("_more_a", F.lit(0)) + F.coalesce("_more_b", F.lit(0))), F.lit(0)).alias("repeats"),
    )
    return out.withColumn("ratio", F.coalesce(F.col("equal") / F.nullif("rows", F.lit(0)), F.lit(1.0)))


class QualityError(RuntimeError):
    """A rule failed and the step was told to stop."""


def require(outcomes: DataFrame) -> None:
    """Raise when a rule failed. Outcomes have one row per rule, so they fit the driver."""
    failed = [r["rule"] for r in outcomes.where(~F.col("passed")).select("rule").collect()]
    if failed:
        raise QualityError("failed: " + "; ".join(sorted(failed)))


def write_checked(df: DataFrame, rules: Sequence[Rule], write, *, stop: str | None = "Immediate") -> DataFrame:
    """Evaluate, call ``write(df)`` and return the outcomes.

    ``Immediate`` stops before the write when a rule failed, ``AfterDataLoad`` after it, None never.
    """
    if stop not in (None, "Immediate", "AfterDataLoad"):
        raise ValueError("stop is Immediate, AfterDataLoad or None")
    outcomes = evaluate(df, rules)
    # A handful of rows, kept so that the checks run once.
    held = df.sparkSession.createDataFrame(outcomes.collect(), outcomes.schema)
    if stop == "Immediate":
        require(held)
    write(df)
    if stop == "AfterDataLoad":
        require(held)
    return held


def publish(outcomes: DataFrame, path: str, context: str) -> None:
    """Add outcomes to a results table, with the evaluation they belong to and when it ran."""
    stamped = outcomes.withColumn("context", F.lit(context)).withColumn("evaluated_at", F.current_timestamp())
    stamped.write.mode("append").parquet(path)
