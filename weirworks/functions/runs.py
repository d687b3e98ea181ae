"""Column expressions and fixed tables for run history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run states by the bucket they count in; any other state is running.
STATE_BUCKETS = {
    "succeeded": ("SUCCEEDED",),
    "failed": ("FAILED", "ERROR", "TIMEOUT"),
    "stopped": ("STOPPED", "STOPPING", "EXPIRED"),
}
BUCKETS = ("succeeded", "failed", "stopped", "running")

# States in which a run has not ended.
OPEN_STATES = ("STARTING", "RUNNING", "STOPPING", "WAITING")

# Processing units per worker; a type not listed counts 1, a run without a worker count has 2.
RUN_WORKER_UNITS = {"G.025X": 0.25, "G.2X": 2.0, "Z.2X": 2.0, "G.4X": 4.0, "G.8X": 8.0, "G.12X": 12.0, "G.16X": 16.0}
SESSION_WORKER_UNITS = {
    "G.025X": 0.25, "G.1X": 1.0, "G.2X": 2.0, "G.4X": 4.0, "G.8X": 8.0, "G.12X": 12.0, "G.16X": 16.0,
    "R.1X": 1.0, "R.2X": 2.0, "R.4X": 4.0, "R.8X": 8.0, "Z.2X": 2.0,
}
DEFAULT_WORKERS = 2
UNIT_HOUR_RATE = 0.44

# Job type by command name; anything else is Spark.
JOB_TYPES = {"gluestreaming": "Streaming", "pythonshell": "Python shell", "glueray": "Ray"}

# Session states in which it still bills.
LIVE_SESSION_STATES = ("PROVISIONING", "READY")


def choose(key: Column, table: dict[str, object], default: object) -> Column:
    """A small fixed table as a CASE expression."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(default)


def state_bucket(state: Column) -> Column:
    out = None
    for bucket, states in STATE_BUCKETS.items():
        out = F.when(state.isin(*states), bucket) if out is None else out.when(state.isin(*states), bucket)
    return out.otherwise("running")


def terminal(state: Column) -> Column:
    """A run without a state counts as ended."""
    return F.coalesce(~state.isin(*OPEN_STATES), F.lit(True))


def job_type(command: Column) -> Column:
    return choose(command, JOB_TYPES, "Spark")


def unit_hours(
    unit_seconds: Column, execution_time: Column, worker_type: Column, workers: Column, max_capacity: Column
) -> Column:
    """Billed unit hours: reported unit seconds when there are any, else workers times units times run time."""
    staff = F.coalesce(workers.cast("double"), max_capacity.cast("double"), F.lit(float(DEFAULT_WORKERS)))
    estimate = staff * choose(worker_type, RUN_WORKER_UNITS, 1.0) * execution_time / 3600.0
    return F.when(unit_seconds > 0, unit_seconds / 3600.0).otherwise(F.coalesce(estimate, F.lit(0.0)))
