"""Run history, sessions and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.functions import runs as fx
from weirworks.operators import metrics, runs
from weirworks.plans.registry import Data, query

NOW = "2001-06-15 12:00:00"
SINCE = f"started_on >= TIMESTAMP '{NOW}' - INTERVAL"

BUCKET = """CASE WHEN state = 'SUCCEEDED' THEN 'succeeded' WHEN state IN ('FAILED', 'ERROR', 'TIMEOUT') THEN 'failed'
  WHEN state IN ('STOPPED', 'STOPPING', 'EXPIRED') THEN 'stopped' ELSE 'running' END"""
UNITS = """CASE WHEN dpu_seconds > 0 THEN dpu_seconds / 3600.0 WHEN execution_time IS NULL THEN 0.0::DOUBLE
  ELSE coalesce(number_of_workers::DOUBLE, max_capacity, 2.0::DOUBLE) * (CASE worker_type WHEN 'G.025X' THEN 0.25 WHEN 'G.2X' THEN 2 WHEN 'Z.2X' THEN 2
    WHEN 'G.4X' THEN 4 WHEN 'G.8X' THEN 8 WHEN 'G.12X' THEN 12 WHEN 'G.16X' THEN 16 ELSE 1 END)::DOUBLE * execution_time / 3600.0::DOUBLE END"""
JOB_TYPE = """CASE command_name WHEN 'gluestreaming' THEN 'Streaming' WHEN 'pythonshell' THEN 'Python shell' WHEN 'glueray' THEN 'Ray' ELSE 'Spark' END"""


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("run_buckets", f"SELECT run_id, {BUCKET} AS bucket FROM runs", "runs")
def run_buckets(d: Data) -> DataFrame:
    return d.runs.select("run_id", fx.state_bucket(F.col("state")).alias("bucket"))


@query(
    "run_window_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (b = 'succeeded') AS succeeded, count(*) FILTER (b = 'failed') AS failed,
         count(*) FILTER (b = 'stopped') AS stopped, count(*) FILTER (b = 'running') AS running,
         CAST(round(sum(CAST(u AS DECIMAL(28,10))), 2) AS DOUBLE) AS unit_hours, round(sum(execution_time) / 36.0::DOUBLE) / 100.0::DOUBLE AS execution_hours
       FROM (SELECT {BUCKET} AS b, {UNITS} AS u, execution_time FROM runs WHERE {SINCE} '8000' HOUR)""",
    "runs",
)
def run_window_summary(d: Data) -> DataFrame:
    return runs.window_summary(runs.in_window(d.runs, now(), 8000))


@query("run_costs", f"SELECT run_id, round({UNITS}, 8) AS unit_hours FROM runs", "runs")
def run_costs(d: Data) -> DataFrame:
    return runs.with_facts(d.runs).select("run_id", F.round("unit_hours", 8).alias("unit_hours"))


@query(
    "run_breakdowns",
    f"""WITH f AS (SELECT {JOB_TYPE} AS job_type, coalesce(worker_type, '—') AS worker, strftime(started_on, '%Y-%m-%d') AS day, {BUCKET} AS bucket FROM runs)
       SELECT 'job_type' AS dimension, job_type AS value, bucket, count(*) AS runs FROM f GROUP BY ALL
       UNION ALL SELECT 'worker', worker, bucket, count(*) FROM f GROUP BY ALL
       UNION ALL SELECT 'day', day, bucket, count(*) FROM f GROUP BY ALL""",
    "runs",
)
def run_breakdowns(d: Data) -> DataFrame:
    return runs.breakdown(d.runs)


@query("run_job_types", f"SELECT job, command_name, {JOB_TYPE} AS job_type, count(*) AS n FROM runs GROUP BY ALL", "runs")
def run_job_types(d: Data) -> DataFrame:
    typed = runs.with_facts(d.runs)
    return typed.groupBy("job", "command_name", "job_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "run_time_histogram",
    f"""WITH s AS (SELECT CAST(range AS INTEGER) AS slot FROM range(30)),
         f AS (SELECT CAST(29 - floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_on)) / 86400000000.0) AS INTEGER) AS slot, {BUCKET} AS b FROM runs)
       SELECT s.slot, count(*) FILTER (b = 'succeeded') AS succeeded, count(*) FILTER (b = 'failed') AS failed,
         count(*) FILTER (b = 'stopped') AS stopped, count(*) FILTER (b = 'running') AS running FROM s LEFT JOIN f ON s.slot = f.slot GROUP BY s.slot""",
    "runs",
)
def run_time_histogram(d: Data) -> DataFrame:
    return runs.time_histogram(d.runs, now(), 720)


@query(
    "run_recent",
    """SELECT job, run_id, state, started_on FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY started_on DESC, run_id DESC) AS rn FROM runs)
       WHERE rn <= 75 ORDER BY started_on DESC, run_id DESC LIMIT 500""",
    "runs",
)
def run_recent(d: Data) -> DataFrame:
    return runs.recent(d.runs.select("job", "run_id", "state", "started_on"), runs.runs_per_job(168))


@query(
    "run_search",
    f"""SELECT job, run_id, bucket, job_type FROM (SELECT *, {BUCKET} AS bucket, {JOB_TYPE} AS job_type FROM runs)
       WHERE (contains(lower(job), 'job_1') OR contains(run_id, 'JOB_1')) AND bucket = 'failed' AND job_type = 'Ray' AND worker_type = 'G.2X'""",
    "runs",
)
def run_search(d: Data) -> DataFrame:
    found = runs.search(d.runs, "JOB_1", bucket="failed", job_type="Ray", worker_type="G.2X")
    return found.select("job", "run_id", "bucket", "job_type")


@query(
    "run_latest_per_job",
    "SELECT job, run_id, state, started_on FROM runs QUALIFY row_number() OVER (PARTITION BY job ORDER BY started_on DESC, run_id DESC) = 1",
    "runs",
)
def run_latest_per_job(d: Data) -> DataFrame:
    return runs.latest_per_job(d.runs)


@query(
    "run_changes",
    """SELECT run_id, seq, state, completed_on, execution_time FROM (SELECT *, lag(state) OVER w AS ps, lag(completed_on) OVER w AS pc,
         lag(execution_time) OVER w AS pe, row_number() OVER w AS rn FROM run_updates WINDOW w AS (PARTITION BY run_id ORDER BY seq))
       WHERE rn = 1 OR state IS DISTINCT FROM ps OR completed_on IS DISTINCT FROM pc
         OR (state NOT IN ('STARTING', 'RUNNING', 'STOPPING', 'WAITING') AND execution_time IS DISTINCT FROM pe)""",
    "run_updates",
)
def run_changes(d: Data) -> DataFrame:
    updates = d.run_updates.select("run_id", "seq", "state", "completed_on", "execution_time")
    return runs.changed_updates(updates)


@query(
    "metric_series",
    """WITH spec AS (SELECT * FROM (VALUES ('bytesRead', 'Sum'), ('driverHeap', 'Average'), ('activeExecutors', 'Maximum'), ('completedTasks', 'Sum'),
           ('recordsRead', 'SampleCount')) t(metric, stat)),
         span AS (SELECT run_id, greatest(60, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 + 180) AS s FROM metrics GROUP BY run_id),
         per AS (SELECT run_id, CAST(CASE WHEN s <= 1800 THEN 60 WHEN s <= 21600 THEN 300 ELSE 900 END AS INTEGER) AS period FROM span),
         slots AS (SELECT m.run_id, m.metric, stat, period, make_timestamp((epoch_us(ts) // 1000000 // period) * period * 1000000) AS slot, value
           FROM metrics m JOIN per p ON m.run_id = p.run_id JOIN spec s ON s.metric = m.metric)
       SELECT run_id, metric, stat, period, slot, CASE stat WHEN 'Sum' THEN CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE)
           WHEN 'Average' THEN CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(value) WHEN 'Maximum' THEN max(value) ELSE CAST(count(value) AS DOUBLE) END AS value
       FROM slots GROUP BY run_id, metric, stat, period, slot""",
    "metrics",
)
def metric_series(d: Data) -> DataFrame:
    out = metrics.resample(d.metrics)
    return out.withColumn("slot", F.col("slot").cast("timestamp_ntz"))


# Points under the names they are recorded by, of runs that each last some hours of their user's first day.
RAW_POINTS = """SELECT concat('jr_', CAST(user_id AS VARCHAR(20))) AS run_id, ts, value, CASE event_type WHEN 'click' THEN 'glue.ALL.s3.filesystem.read_bytes'
    WHEN 'view' THEN 'glue.driver.jvm.heap.usage' WHEN 'purchase' THEN 'glue.driver.ExecutorAllocationManager.executors.numberAllExecutors'
    WHEN 'signup' THEN 'glue.driver.aggregate.numCompletedTasks' ELSE 'other.name' END AS source FROM events"""
RAW_RUNS = """SELECT concat('jr_', CAST(user_id AS VARCHAR(20))) AS run_id, date_trunc('day', min(ts)) AS started_on,
    date_trunc('day', min(ts)) + INTERVAL '1' HOUR * CAST(1 + user_id % 90 AS INTEGER) AS completed_on FROM events GROUP BY user_id"""


@query(
    "metric_dashboard",
    f"""WITH points AS ({RAW_POINTS}), runs AS ({RAW_RUNS}),
         spec AS (SELECT * FROM (VALUES {", ".join(str(s) for s in metrics.SERIES)}) t(id, source, kind, stat, label, unit, grouping)),
         spans AS (SELECT run_id, epoch_us(started_on) // 1000000 - 60 AS lo, epoch_us(completed_on) // 1000000 + 120 AS hi FROM runs),
         per AS (SELECT *, CASE WHEN greatest(60, hi - lo) <= 1800 THEN 60 WHEN greatest(60, hi - lo) <= 21600 THEN 300 ELSE 900 END AS period FROM spans),
         held AS (SELECT p.run_id, id, label, unit, grouping, stat, period, (epoch_us(ts) // 1000000 // period) * period AS sec, value
           FROM points p JOIN per r ON r.run_id = p.run_id AND epoch_us(ts) >= lo * 1000000 AND epoch_us(ts) <= hi * 1000000 JOIN spec s ON s.source = p.source),
         found AS (SELECT run_id, id, label, unit, grouping, stat, period, sec, CASE stat WHEN 'Sum' THEN CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE)
             WHEN 'Average' THEN CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(value) WHEN 'Maximum' THEN max(value) ELSE CAST(count(value) AS DOUBLE) END AS value
           FROM held GROUP BY run_id, id, label, unit, grouping, stat, period, sec),
         spine AS (SELECT DISTINCT f.run_id, id, label, unit, grouping, stat, f.period, unnest(range(lo // r.period, hi // r.period + 1)) * r.period AS sec
           FROM (SELECT DISTINCT run_id, id, label, unit, grouping, stat, period FROM found) f JOIN per r ON r.run_id = f.run_id)
       SELECT s.run_id, s.id, s.label, s.unit, s.grouping, s.stat, CAST(s.period AS INTEGER) AS period, make_timestamp(s.sec * 1000000) AS slot, value
       FROM spine s LEFT JOIN found f ON f.run_id = s.run_id AND f.id = s.id AND f.sec = s.sec""",
)
def metric_dashboard(d: Data) -> DataFrame:
    """Read bytes feed two series; empty slots stay, so a chart shows its gaps."""
    d.events.createOrReplaceTempView("events")
    out = metrics.dashboard(d.spark.sql(RAW_POINTS), d.spark.sql(RAW_RUNS))
    return out.withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@query(
    "metric_series_of_runs",
    """WITH r AS (SELECT run_id, started_on - INTERVAL '60' SECOND AS lo, completed_on + INTERVAL '120' SECOND AS hi FROM (SELECT concat('jr_', user_id) AS run_id,
           date_trunc('day', min(ts)) AS started_on, date_trunc('day', min(ts)) + INTERVAL '2' HOUR * (1 + user_id % 40) AS completed_on FROM events GROUP BY user_id)),
         per AS (SELECT *, CASE WHEN greatest(60, epoch_us(hi) // 1000000 - epoch_us(lo) // 1000000) <= 21600 THEN 300 ELSE 900 END AS period FROM r)
       SELECT m.run_id, metric, make_timestamp((epoch_us(ts) // 1000000 // period) * period * 1000000) AS slot, count(*) AS n
       FROM metrics m JOIN per p ON m.run_id = p.run_id AND ts >= lo AND ts <= hi WHERE metric = 'recordsRead' GROUP BY ALL""",
    "metrics",
)
def metric_series_of_runs(d: Data) -> DataFrame:
    d.events.createOrReplaceTempView("events")
    spans = d.spark.sql(
        """SELECT concat('jr_', user_id) AS run_id, date_trunc('day', min(ts)) AS started_on,
             date_trunc('day', min(ts)) + INTERVAL '2' HOUR * (1 + user_id % 40) AS completed_on FROM events GROUP BY user_id"""
    )
    out = metrics.resample(d.metrics, spans).where("metric = 'recordsRead'")
    return out.select("run_id", "metric", F.col("slot").cast("timestamp_ntz").alias("slot"), F.col("value").cast("bigint").alias("n"))


@query("metric_names", "SELECT DISTINCT run_id, metric FROM metrics ORDER BY run_id, metric", "metrics")
def metric_names(d: Data) -> DataFrame:
    return metrics.available(d.metrics)


@query(
    "session_costs",
    """WITH last AS (SELECT session_id, max(coalesce(completed_on, started_on)) AS used FROM statements GROUP BY session_id),
         s AS (SELECT *, (CASE coalesce(worker_type, 'G.1X') WHEN 'G.025X' THEN 0.25 WHEN 'G.2X' THEN 2 WHEN 'R.4X' THEN 4 WHEN 'Z.2X' THEN 2 ELSE 1 END)::DOUBLE
             * coalesce(number_of_workers, 2) AS units FROM sessions)
       SELECT s.session_id, units, round(units * 0.44::DOUBLE, 6) AS per_hour, round(dpu_seconds / 3600 * 0.44::DOUBLE, 6) AS spent,
         CASE WHEN status IN ('PROVISIONING', 'READY') AND idle_timeout > 0 THEN CAST(greatest(0, floor(idle_timeout
           - (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(coalesce(used, created_on))) / 60000000.0::DOUBLE + 0.5::DOUBLE)) AS INTEGER) END AS idle_minutes_left
       FROM s LEFT JOIN last ON s.session_id = last.session_id""",
    "sessions", "statements",
)
def session_costs(d: Data) -> DataFrame:
    out = runs.session_costs(d.sessions, d.statements, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return out.withColumn("per_hour", F.round("per_hour", 6)).withColumn("spent", F.round("spent", 6))
