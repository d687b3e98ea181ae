"""Failure signatures in a followed log, with exclusions that hold for the whole run.

A line alone cannot tell: a later line of the run may exclude a rule that an earlier one met. So hits are held per run in
Spark's keyed state until the run has been silent for ``idle`` (an event-time timer) or is heard of again after such a
silence; then the rules that nothing excluded are given out, each with its first line.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weirworks.functions import signatures as sig
from weirworks.operators.logs import rule_marks
from weirworks.streaming.flow import timed

OUT = "run_id string, rule int, event_id bigint, at bigint, opened bigint"


class _Held(StatefulProcessor):
    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Per rule the first line that met it, or null once it is excluded: as many entries as there are rules.
        self.state = handle.getValueState("run", "opened bigint, last bigint, timer bigint, rules string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        opened, last, timer, rules = (held[0], held[1], held[2], json.loads(held[3])) if held else (None, None, None, {})
        out = []
        for at, event, marks in zip(lines["at"].tolist(), lines["event_id"].tolist(), lines["marks"].tolist(), strict=True):
            if last is not None and at - last > self.idle:
                out += _given(key[0], opened, rules)
                opened, last, rules = None, None, {}
            opened = at if opened is None else min(opened, at)
            last = at if last is None else max(last, at)
            for mark in marks.split(",") if marks else ():
                rule, excludes = mark[:-1], mark[-1] == "1"
                if excludes:
                    rules[rule] = None
                elif rule not in rules or (rules[rule] is not None and [at, event] < rules[rule]):
                    rules[rule] = [at, event]
        due = (last + self.idle) // 1000 + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.state.update((opened, last, due, json.dumps(rules)))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        opened, _, _, rules = self.state.get()
        self.state.clear()
        out = _given(key[0], opened, json.loads(rules))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _given(run: str, opened: int, rules: dict[str, list[int] | None]) -> list[tuple]:
    return [(run, int(rule), first[1], first[0], opened) for rule, first in sorted(rules.items()) if first]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def run_signatures(
    lines: DataFrame, idle_seconds: int, delay: str, text: str = "line", rules: Sequence[sig.Signature] = sig.SIGNATURES
) -> DataFrame:
    """Rules met by the runs of a stream of lines (run_id, ts, event_id, ``text``) that no line of the same run excludes.

    A run is over when it was silent for more than ``idle_seconds``. Result: run_id, opened (its first line's time), id
    (the rule), event_id and at (the first line that met it). Lines later than ``delay`` behind the newest are dropped;
    those within it join the run that is held. A run's lines of one batch are sorted in its task. Lines without a run, a
    time or a number are ignored.
    """
    whole = lines.where("run_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL")
    coded = F.transform(
        F.filter(rule_marks(F.col(text), rules), lambda m: m.isNotNull()),
        lambda m: F.concat(m["rule"].cast("string"), F.when(m["excludes"], "1").otherwise("0")),
    )
    # Most lines hit nothing: one pattern that holds them all is tried first.
    any_rule = "(?i)" + "|".join(f"(?:{p})" for r in rules for p in (r.pattern, r.unless) if p)
    marks = F.when(F.col(text).rlike(any_rule), F.array_join(coded, ",")).otherwise("")
    seen = timed(whole.select("run_id", "ts", "event_id", marks.alias("marks")), "ts", delay)
    rows = seen.select("run_id", "ts", "event_id", "marks", F.unix_micros("ts").alias("at"))
    held = rows.groupBy("run_id").transformWithStateInPandas(_Held(idle_seconds * 1_000_000), OUT, "Append", "EventTime")
    names = F.element_at(F.array(*[F.lit(r.id) for r in rules]), F.col("rule") + 1)
    return held.select("run_id", F.timestamp_micros("opened").alias("opened"), names.alias("id"), "event_id", F.timestamp_micros("at").alias("at"))
