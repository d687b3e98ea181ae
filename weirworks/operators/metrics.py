"""Metric series of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.operators.joins import join_unique

# Series id, metric name, type, statistic, label, unit and group.
SERIES = (
    ("bytesRead", "glue.ALL.s3.filesystem.read_bytes", "gauge", "Sum", "S3 bytes read", "bytes", "Data movement"),
    ("bytesWritten", "glue.ALL.s3.filesystem.write_bytes", "gauge", "Sum", "S3 bytes written", "bytes", "Data movement"),
    ("driverHeap", "glue.driver.jvm.heap.usage", "gauge", "Average", "Driver heap used", "percent", "Memory"),
    ("executorHeap", "glue.ALL.jvm.heap.usage", "gauge", "Average", "Executor heap used (avg)", "percent", "Memory"),
    ("driverCpu", "glue.driver.system.cpuSystemLoad", "gauge", "Average", "Driver CPU load", "percent", "CPU"),
    ("executorCpu", "glue.ALL.system.cpuSystemLoad", "gauge", "Average", "Executor CPU load (avg)", "percent", "CPU"),
    ("neededExecutors", "glue.driver.ExecutorAllocationManager.executors.numberMaxNeededExecutors", "gauge", "Maximum", "Executors needed", "count", "Executors"),
    ("activeExecutors", "glue.driver.ExecutorAllocationManager.executors.numberAllExecutors", "gauge", "Maximum", "Executors active", "count", "Executors"),
    ("completedStages", "glue.driver.aggregate.numCompletedStages", "count", "Sum", "Stages completed", "count", "Progress"),
    ("completedTasks", "glue.driver.aggregate.numCompletedTasks", "count", "Sum", "Tasks completed", "count", "Progress"),
    ("failedTasks", "glue.driver.aggregate.numFailedTasks", "count", "Sum", "Tasks failed", "count", "Progress"),
    ("shuffleRead", "glue.driver.aggregate.shuffleLocalBytesRead", "gauge", "Sum", "Shuffle bytes read", "bytes", "Shuffle"),
    ("shuffleWritten", "glue.driver.aggregate.shuffleBytesWritten", "gauge", "Sum", "Shuffle bytes written", "bytes", "Shuffle"),
    ("recordsRead", "glue.ALL.s3.filesystem.read_bytes", "gauge", "SampleCount", "Read samples", "count", "Data movement"),
)
SERIES_SCHEMA = "metric string, source string, type string, stat string, label string, unit string, grouping string"

# Seconds added before the start and after the end of a run, spans and their slot lengths.
LEAD_SECONDS, TAIL_SECONDS, LEAST_SPAN = 60, 120, 60
PERIODS = ((1800, 60), (21600, 300))
LONGEST_PERIOD = 900


def series_table(spark) -> DataFrame:
    return spark.createDataFrame(list(SERIES), SERIES_SCHEMA)


def _period(seconds: Column) -> Column:
    span = F.greatest(F.lit(LEAST_SPAN), seconds)
    period = F.lit(LONGEST_PERIOD)
    for limit, slot in reversed(PERIODS):
        period = F.when(span <= limit, slot).otherwise(period)
    return period


def _spans(runs: DataFrame, now: Column) -> tuple[Column, Column, DataFrame]:
    started, completed = F.col("started_on").cast("timestamp"), F.col("completed_on").cast("timestamp")
    lead = F.coalesce(started - F.expr(f"INTERVAL {LEAD_SECONDS} SECONDS"), now - F.expr("INTERVAL 1 HOUR"))
    tail = F.coalesce(completed + F.expr(f"INTERVAL {TAIL_SECONDS} SECONDS"), now)
    return lead, tail, runs.select("run_id", "started_on", "completed_on")


def resample(points: DataFrame, runs: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """``(run_id, metric, ts, value)`` points to one value per slot, slots as long as the run's span allows.

    The span of a run is taken from ``runs`` (``run_id, started_on, completed_on``; ``now`` stands in for an end
    that is missing), and points outside it are left out. Without ``runs`` it reaches from the first point of
    the run to the last. The statistic is the one its series names; a metric of no series is averaged. One partial aggregation per minute comes
    first; minutes fit every slot length, so nothing larger is ever regrouped.
    """
    if runs is not None:
        start, end, spans = _spans(runs, F.current_timestamp() if now is None else now.cast("timestamp"))
        bounds = spans.select("run_id", start.alias("_from"), end.alias("_to"))
        points = join_unique(points, bounds, ["run_id"]).where(F.col("ts").cast("timestamp").between(F.col("_from"), F.col("_to")))
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    minutes = points.groupBy("run_id", "metric", minute.alias("minute")).agg(
        F.sum(F.col("value").cast("decimal(28,6)")).alias("s"), F.count("value").alias("n"), F.max("value").alias("m"),
        F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    if runs is not None:
        spans = spans.select("run_id", _period(F.unix_seconds(end) - F.unix_seconds(start)).alias("period"))
    else:
        seconds = F.unix_seconds(F.max("last").cast("timestamp")) - F.unix_seconds(F.min("first").cast("timestamp"))
        spans = minutes.groupBy("run_id").agg(_period(seconds + LEAD_SECONDS + TAIL_SECONDS).alias("period"))
    specs = series_table(points.sparkSession).select("metric", "stat")
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("minute") / F.col("period")) * F.col("period"))
    slots = (
        minutes.join(spans, "run_id").join(F.broadcast(specs), "metric", "left").fillna("Average", ["stat"])  # 14 specs
        .groupBy("run_id", "metric", "stat", "period", slot.alias("slot"))
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("m").alias("m"))
    )
    value = (
        F.when(F.col("stat") == "Sum", F.col("s").cast("double"))
        .when(F.col("stat") == "Average", F.col("s").cast("double") / F.col("n"))
        .when(F.col("stat") == "Maximum", F.col("m"))
        .otherwise(F.col("n").cast("double"))
    )
    return slots.select("run_id", "metric", "stat", "period", "slot", value.alias("value"))


def dashboard(points: DataFrame, runs: DataFrame, now: Column | None = None) -> DataFrame:
    """Every series of every run, slot by slot, from points under the names they are recorded by.

    ``points`` has (run_id, source, ts, value), ``runs`` (run_id, started_on, completed_on). A source feeds every series
    that names it, so read bytes come out as a sum and as a number of samples; a source of no series is left out. A series that
    has points has a row for each slot of its run's span, with a null value where nothing was recorded; one without points has none.
    Result: run_id, id, label, unit, grouping, stat, period, slot, value. Points are summed per minute before they meet
    the series, and the slots of a span are generated from its bounds.
    """
    clock = F.current_timestamp() if now is None else now.cast("timestamp")
    start, end, spans = _spans(runs, clock)
    spans = spans.select("run_id", start.alias("_from"), end.alias("_to"), _period(F.unix_seconds(end) - F.unix_seconds(start)).alias("period"))
    inside = join_unique(points, spans.select("run_id", "_from", "_to"), ["run_id"])
    inside = inside.where(F.col("ts").cast("timestamp").between(F.col("_from"), F.col("_to")))
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute")
    minutes = inside.groupBy("run_id", "source", minute).agg(
        F.sum(F.col("value").cast("decimal(28,6)")).alias("s"), F.count("value").alias("n"), F.max("value").alias("m")
    )
    specs = F.broadcast(series_table(points.sparkSession))  # 14 rows
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("minute") / F.col("period")) * F.col("period"))
    held = minutes.join(spans.select("run_id", "period"), "run_id").join(specs, "source")
    held = held.groupBy("run_id", F.col("metric").alias("id"), "label", "unit", "grouping", "stat", "period", slot.alias("slot"))
    held = held.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("m").alias("m")).where("n > 0")
    value = (
        F.when(F.col("stat") == "Sum", F.col("s").cast("double"))
        .when(F.col("stat") == "Average", F.col("s").cast("double") / F.col("n"))
        .when(F.col("stat") == "Maximum", F.col("m"))
        .otherwise(F.col("n").cast("double"))
    )
    names = ["run_id", "id", "label", "unit", "grouping", "stat", "period"]
    found = held.select(*names, "slot", value.alias("value"))
    first, last = (F.floor(F.unix_seconds(c) / F.col("period")) * F.col("period") for c in ("_from", "_to"))
    spine = found.select(*names).distinct().join(spans.drop("period"), "run_id")
    spine = spine.select(*names, F.explode(F.sequence(first, last, F.col("period").cast("long"))).alias("_at"))
    return spine.withColumn("slot", F.timestamp_seconds("_at")).drop("_at").join(found, [*names, "slot"], "left")


def available(points: DataFrame, run_id: str | None = None) -> DataFrame:
    """Names of the metrics that have points, per run or for one run, in order."""
    narrow = points.select("run_id", "metric") if run_id is None else points.where(F.col("run_id") == run_id).select("metric")
    return narrow.distinct().orderBy(*narrow.columns)
