"""Change events: decoding, and the rows that cannot be decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Message types and API calls that change a run or a job, and what each one does.
RUN_EVENTS = ("Glue Job State Change", "Glue Job Run Status")
CALL_EVENT = "AWS API Call via CloudTrail"
JOB_CALLS = ("CreateJob", "UpdateJob")
DELETE_CALL, START_CALL, STOP_CALL = "DeleteJob", "StartJobRun", "BatchStopJobRun"

MESSAGE = """`detail-type` string, broken string, detail struct<jobName string, jobRunId string, state string, eventName string,
  requestParameters: struct<jobName string, name string, jobRunIds array<string>>, responseElements: struct<jobRunId string>>"""


def _parsed(df: DataFrame, column: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    return df.withColumn("_m", F.from_json(column, MESSAGE, options))


def broken(df: DataFrame, column: str = "value") -> DataFrame:
    """Messages that are not valid JSON, for a quarantine sink."""
    return _parsed(df, column).where(F.col("_m.broken").isNotNull() | F.col("_m").isNull()).drop("_m")


def decode(df: DataFrame, column: str = "value") -> DataFrame:
    """``(action, job, run_id)`` per change: ``run``, ``job`` or ``removed``. Anything else is left out."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    kind, detail = F.col("_m.`detail-type`"), F.col("_m.detail")
    call = detail["eventName"]
    request = detail["requestParameters"]
    direct = kind.isin(*RUN_EVENTS)
    job = F.when(direct, detail["jobName"]).otherwise(F.coalesce(request["jobName"], request["name"]))
    runs = (
        F.when(direct, F.array(detail["jobRunId"]))
        .when(call == START_CALL, F.array(detail["responseElements"]["jobRunId"]))
        .when(call == STOP_CALL, request["jobRunIds"])
    )
    # A stop without ids, or a run without an id, yields nothing.
    runs = F.filter(runs, lambda r: r.isNotNull() & (r != ""))
    per_job = F.array(F.lit(None).cast("string"))
    made = F.when(direct | call.isin(START_CALL, STOP_CALL), runs).otherwise(per_job)
    action = F.when(direct | call.isin(START_CALL, STOP_CALL), "run").when(call.isin(*JOB_CALLS), "job").when(call == DELETE_CALL, "removed")
    parsed = _parsed(df, column).where(F.col("_m.broken").isNull()).where(direct | (kind == CALL_EVENT))
    named = parsed.select(*rest, action.alias("action"), job.alias("job"), made.alias("_runs")).where("action IS NOT NULL AND job <> ''")
    return named.select(*rest, "action", "job", F.explode("_runs").alias("run_id"))
