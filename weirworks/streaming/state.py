"""The latest run of every job, kept in Spark's keyed state.

Every accepted change is told, in order. An update that only moves the running time of the run held is no change, but the
state keeps it, and a batch that ends with such an update gives the run once more, untold, so that tables built from the
stream end with the newest update.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weirworks.functions.runs import OPEN_STATES

COLUMNS = ("job", "run_id", "state", "started_on", "completed_on", "execution_time", "seq")
SCHEMA = "job string, run_id string, state string, started_on timestamp, completed_on timestamp, execution_time int, seq bigint"
# Times and whole numbers travel as numbers that are never null, so that pandas leaves them as they are.
NONE = -(2**63)
FAR = 2**63 - 1
HELD = "run_id string, state string, started bigint, completed bigint, took bigint, change bigint, step bigint"
TOLD = "job string, run_id string, state string, started bigint, completed bigint, took bigint, seq bigint, change bigint, step bigint, told boolean"

FIELDS = ("run_id", "state", "started", "completed", "took", "seq")
ROW = pa.schema([(c, pa.string() if c in ("run_id", "state") else pa.int64()) for c in FIELDS])
# Rows a task sorts at a time, reads back at a time from each sorted part, and gives out at a time.
SORTED, READ, GIVEN = 500_000, 2_000, 10_000


def accepted(held: tuple | None, new: tuple) -> bool:
    """Whether ``new`` changes what is held; both are (run_id, state, started, completed, took).

    A run that started before the one held is ignored unless it is the same run. The same run with the same state and
    end is no change; its running time counts only once it has ended.
    """
    if held is None:
        return True
    same_run = held[0] == new[0]
    if not same_run and new[2] < held[2]:
        return False
    same = same_run and held[1] == new[1] and held[3] == new[3]
    return not (same and (new[1] in OPEN_STATES or held[4] == new[4]))


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True)


def _sorted_part(chunks: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(chunks).combine_chunks().sort_by("seq")


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The updates of one job as tuples (``FIELDS``) by ``seq``, those of one ``seq`` as they came.

    Beyond ``SORTED`` rows, sorted parts lie in temporary files of the task and are merged, so that memory does not grow
    with the number of updates.
    """
    files, held, n = [], [], 0
    for chunk in rows:
        held.append(pa.Table.from_pandas(chunk[list(FIELDS)], ROW, preserve_index=False))
        n += len(chunk)
        if n >= SORTED:
            file = tempfile.TemporaryFile()  # noqa: SIM115
            with pa.ipc.new_stream(file, ROW) as writer:
                writer.write_table(_sorted_part(held), READ)
            file.seek(0)
            files.append(file)
            held, n = [], 0
    parts = [_tuples(iter(pa.ipc.open_stream(f))) for f in files]
    if held:
        parts.append(_tuples(iter(_sorted_part(held).to_batches(READ))))
    # Equal ones come from the earlier part first.
    yield from heapq.merge(*parts, key=itemgetter(5)) if len(parts) > 1 else parts[0]
    for file in files:
        file.close()


class _Changes(StatefulProcessor):
    """One held run per job; the updates of a batch are applied in the order of ``seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("latest_run", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = self._told(key[0], in_order(rows))
        while part := list(islice(out, GIVEN)):
            yield pd.DataFrame(part, columns=[c.split()[0] for c in TOLD.split(", ")])

    def _told(self, job: str, updates: Iterator[tuple]) -> Iterator[tuple]:
        before = self.held.get() if self.held.exists() else None
        held, change, step = (tuple(before[:5]), before[5], before[6]) if before else (None, 0, 0)
        first, quiet = step, None
        for *new, seq in updates:
            new = tuple(new)
            if accepted(held, new):
                held, change, step, quiet = new, change + 1, step + 1, None
                yield (job, *new, seq, change, step, True)
            elif held[0] == new[0] and held[4] != new[4]:
                held = quiet = (*held[:4], new[4])
                last = seq
        if quiet:
            step += 1
            yield (job, *quiet, last, change, step, False)
        if step > first:
            self.held.update((*held, change, step))

    def close(self) -> None:
        pass


def _number(value: Column, none: int) -> Column:
    return F.coalesce(value.cast("bigint"), F.lit(none).cast("bigint"))


def _time(name: str, none: int) -> Column:
    return F.when(F.col(name) != none, F.timestamp_micros(name))


def run_changes(updates: DataFrame) -> DataFrame:
    """Every accepted change of the jobs in the stream ``updates`` (``COLUMNS``), numbered per job from 1 in ``change``.

    ``step`` numbers all rows of a job; those without ``told`` only move the running time of the change they carry.
    A batch's updates of a job are applied in the order of ``seq``, batches in the order in which they come; a job's
    updates of one batch are sorted in its task, on disk if they are many. Updates without a job,
    a run or a ``seq`` are ignored. A run without a start counts as just started.
    """
    known = updates.where("job IS NOT NULL AND run_id IS NOT NULL AND seq IS NOT NULL").select(
        "job",
        "run_id",
        F.coalesce("state", F.lit("")).alias("state"),
        _number(F.unix_micros("started_on"), FAR).alias("started"),
        _number(F.unix_micros("completed_on"), NONE).alias("completed"),
        _number(F.col("execution_time"), NONE).alias("took"),
        "seq",
    )
    told = known.groupBy("job").transformWithStateInPandas(_Changes(), TOLD, "Append", "None")
    return told.select(
        "job",
        "run_id",
        F.nullif("state", F.lit("")).alias("state"),
        _time("started", FAR).alias("started_on"),
        _time("completed", NONE).alias("completed_on"),
        F.when(F.col("took") != NONE, F.col("took").cast("int")).alias("execution_time"),
        "seq",
        "change",
        "step",
        "told",
    )


def current(changes: DataFrame) -> DataFrame:
    """The latest run of every job, from all rows of ``run_changes`` so far."""
    body = F.struct(*[F.col(c) for c in changes.columns if c != "job"])
    return changes.groupBy("job").agg(F.max_by(body, "step").alias("r")).select("job", "r.*")
