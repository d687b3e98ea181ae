"""Run history: summaries, breakdowns, time histograms, latest and changed runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.functions import runs as fx
from weirworks.operators.ordered import top_per_key, with_previous


def with_facts(runs: DataFrame) -> DataFrame:
    """Runs with ``bucket``, ``job_type`` and ``unit_hours``."""
    return runs.withColumns(
        {
            "bucket": fx.state_bucket(F.col("state")),
            "job_type": fx.job_type(F.col("command_name")),
            "unit_hours": fx.unit_hours(
                F.col("dpu_seconds"), F.col("execution_time"), F.col("worker_type"), F.col("number_of_workers"), F.col("max_capacity")
            ),
        }
    )


def in_window(runs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Runs started within ``hours`` before ``now``. A plain comparison, so a literal ``now`` reaches the scan."""
    return runs.where(F.col("started_on") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def window_summary(runs: DataFrame) -> DataFrame:
    """One row: runs per bucket, unit hours and execution hours to two decimals."""
    facts = with_facts(runs)
    per_bucket = [F.count_if(F.col("bucket") == b).alias(b) for b in fx.BUCKETS]
    # Sums of exact decimals do not depend on the order the rows arrive in.
    cost = F.sum(F.col("unit_hours").cast("decimal(28,10)"))
    seconds = F.sum(F.coalesce("execution_time", F.lit(0)).cast("bigint"))
    return facts.agg(
        F.count(F.lit(1)).alias("total"),
        *per_bucket,
        F.round(F.coalesce(cost, F.lit(0)), 2).cast("double").alias("unit_hours"),
        F.round(F.coalesce(seconds / F.lit(36).cast("decimal(4,0)"), F.lit(0)).cast("decimal(28,6)"), 0).cast("double").alias("_h"),
    ).withColumn("execution_hours", F.col("_h") / 100.0).drop("_h")


def breakdown(runs: DataFrame) -> DataFrame:
    """Runs per bucket by job type, worker type and day: ``(dimension, value, bucket, runs)`` in one pass."""
    facts = with_facts(runs).select(
        "job_type", F.coalesce("worker_type", F.lit("—")).alias("worker"), F.date_format("started_on", "yyyy-MM-dd").alias("day"), "bucket"
    )
    grouped = facts.groupBy("job_type", "worker", "day", "bucket").agg(F.count(F.lit(1)).alias("n"))
    views = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("job_type", "worker", "day")])
    return (
        grouped.select(F.inline(views), "bucket", "n").groupBy("dimension", "value", "bucket").agg(F.sum("n").alias("runs"))
    )


def slot_hours(hours: int) -> int:
    """Slots of 2 hours up to a day, 6 up to three days, 24 beyond."""
    return 2 if hours <= 24 else 6 if hours <= 72 else 24


def time_histogram(runs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Runs per slot and bucket with slots ending at ``now``; slots without runs are kept.

    Slot 0 is the oldest. The spine has as many rows as the window has slots.
    """
    size = slot_hours(hours)
    slots = max(1, int(hours / size + 0.5))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started_on").cast("timestamp"))
    slot = (F.lit(slots - 1) - F.floor(age / (size * 3_600_000_000))).cast("int")
    # A plain comparison first, so that partitions and row groups outside the window are not read.
    near = in_window(runs, now, slots * size).where(F.col("started_on") <= now)
    counts = (
        with_facts(near).select(slot.alias("slot"), "bucket").where(F.col("slot").between(0, slots - 1))
        .groupBy("slot").pivot("bucket", list(fx.BUCKETS)).agg(F.count(F.lit(1)))
    )
    spine = runs.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return spine.join(counts, "slot", "left").fillna(0, list(fx.BUCKETS))


def recent(runs: DataFrame, per_job: int, cap: int = 500) -> DataFrame:
    """Newest runs first, at most ``per_job`` of any job and ``cap`` overall."""
    newest = [F.desc("started_on"), F.desc("run_id")]
    return top_per_key(runs, ["job"], newest, per_job).orderBy(*newest).limit(cap)


def runs_per_job(hours: int) -> int:
    """How many runs of one job a window looks at."""
    return 25 if hours <= 24 else 75 if hours <= 168 else 200


def search(
    runs: DataFrame, text: str = "", *, bucket: str = "", job_type: str = "", worker_type: str = ""
) -> DataFrame:
    """Runs whose job contains the text in any case, or whose id contains it, narrowed by exact facets."""
    out = with_facts(runs)
    if text:
        out = out.where(F.lower("job").contains(text.lower()) | F.col("run_id").contains(text))
    if bucket:
        out = out.where(F.col("bucket") == bucket)
    if job_type:
        out = out.where(F.col("job_type") == job_type)
    if worker_type:
        out = out.where(F.col("worker_type") == worker_type)
    return out


def latest_per_job(runs: DataFrame, columns: Sequence[str] = ("run_id", "state", "started_on")) -> DataFrame:
    """The newest run of each job, by partial aggregation: one row per job and task reaches the shuffle."""
    newest = F.max_by(F.struct(*columns), F.struct("started_on", "run_id"))
    return runs.groupBy("job").agg(newest.alias("r")).select("job", "r.*")


def changed_updates(updates: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Updates of a run that differ from the one before: state, completion or, once ended, run time."""
    watched = ["state", "completed_on", "execution_time"]
    seen = with_previous(updates, ["run_id"], order, watched)
    same = (
        F.col("state").eqNullSafe(F.col("prev_state"))
        & F.col("completed_on").eqNullSafe(F.col("prev_completed_on"))
        & (~fx.terminal(F.col("state")) | F.col("execution_time").eqNullSafe(F.col("prev_execution_time")))
    )
    return seen.where(~F.col("has_prev") | ~same).select(*updates.columns)


def session_costs(sessions: DataFrame, statements: DataFrame, now: Column) -> DataFrame:
    """Cost per hour and so far of each session, and the minutes left before the idle timeout ends it."""
    last = statements.groupBy("session_id").agg(F.max(F.coalesce("completed_on", "started_on")).alias("last_used"))
    units = fx.choose(F.coalesce("worker_type", F.lit("G.1X")), fx.SESSION_WORKER_UNITS, 1.0) * F.coalesce(
        F.col("number_of_workers"), F.lit(fx.DEFAULT_WORKERS)
    )
    live = F.col("status").isin(*fx.LIVE_SESSION_STATES)
    since = F.coalesce("last_used", "created_on")
    idle = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 60_000_000
    # Half a minute rounds up, also below zero.
    left = F.greatest(F.lit(0), F.floor(F.col("idle_timeout") - idle + 0.5)).cast("int")
    return sessions.join(last, "session_id", "left").select(
        "session_id",
        units.alias("units"),
        (units * fx.UNIT_HOUR_RATE).alias("per_hour"),
        (F.coalesce("dpu_seconds", F.lit(0.0)) / 3600 * fx.UNIT_HOUR_RATE).alias("spent"),
        F.when(live & (F.col("idle_timeout") > 0) & since.isNotNull(), left).alias("idle_minutes_left"),
    )
