"""Streaming queries, run over all that is there and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks import sources
from weirworks.functions import signatures as sig
from weirworks.operators import logs
from weirworks.plans.observe import RULES_SQL
from weirworks.plans.registry import Data, query
from weirworks.session import scratch_path
from weirworks.streaming import events, flow, followed, state, windows


def _drained(d: Data, stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over all there is and read back what it wrote."""
    out = scratch_path(d.spark, name)
    flow.load_new(stream, out, scratch_path(d.spark, f"{name}-checkpoint"))
    return d.spark.read.schema(stream.schema).parquet(out)


def _events(d: Data) -> DataFrame:
    # A pattern, since a stream takes a folder or a pattern but not the name of a single file.
    return flow.source(d.spark, "parquet", schema=d.events.schema, path=f"{d.folder}/events[.]parquet")


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("stream_source", "SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase'")
def stream_source(d: Data) -> DataFrame:
    return _drained(d, _events(d).where("event_type = 'purchase'").select("event_id", "event_type", "value"), "purchases")


MESSAGES = """SELECT event_id AS at, CASE event_id % 9
    WHEN 0 THEN concat('{"detail-type":"Glue Job State Change","detail":{"jobName":"job_', CAST(user_id AS VARCHAR(20)), '","state":"FAILED","jobRunId":"jr_', CAST(event_id AS VARCHAR(20)), '"}}')
    WHEN 1 THEN concat('{"detail-type":"Glue Job Run Status","detail":{"jobName":"job_', CAST(user_id AS VARCHAR(20)), '","jobRunId":""}}')
    WHEN 2 THEN concat('{"detail-type":"AWS API Call via CloudTrail","detail":{"eventName":"CreateJob","requestParameters":{"name":"job_', CAST(user_id AS VARCHAR(20)), '"}}}')
    WHEN 3 THEN concat('{"detail-type":"AWS API Call via CloudTrail","detail":{"eventName":"DeleteJob","requestParameters":{"jobName":"job_', CAST(user_id AS VARCHAR(20)), '"}}}')
    WHEN 4 THEN concat('{"detail-type":"AWS API Call via CloudTrail","detail":{"eventName":"StartJobRun","requestParameters":{"jobName":"job_', CAST(user_id AS VARCHAR(20)), '"},"responseElements":{"jobRunId":"jr_', CAST(event_id AS VARCHAR(20)), '"}}}')
    WHEN 5 THEN concat('{"detail-type":"AWS API Call via CloudTrail","detail":{"eventName":"BatchStopJobRun","requestParameters":{"jobName":"job_', CAST(user_id AS VARCHAR(20)), '","jobRunIds":["jr_a', CAST(event_id AS VARCHAR(20)), '","jr_b', CAST(event_id AS VARCHAR(20)), '"]}}}')
    WHEN 6 THEN '{"detail-type":"Something Else","detail":{}}' WHEN 7 THEN concat('{"detail-type": ', event_type)
    ELSE '{"detail-type":"AWS API Call via CloudTrail","detail":{"eventName":"GetJob","requestParameters":{"jobName":"x"}}}' END AS value FROM events"""


def _messages(d: Data) -> DataFrame:
    d.events.createOrReplaceTempView("events")
    return d.spark.sql(MESSAGES)


@query(
    "stream_event_decoding",
    """SELECT event_id AS at, 'run' AS action, concat('job_', user_id) AS job, concat('jr_', event_id) AS run_id FROM events WHERE event_id % 9 IN (0, 4)
       UNION ALL SELECT event_id, 'job', concat('job_', user_id), NULL FROM events WHERE event_id % 9 = 2
       UNION ALL SELECT event_id, 'removed', concat('job_', user_id), NULL FROM events WHERE event_id % 9 = 3
       UNION ALL SELECT event_id, 'run', concat('job_', user_id), concat('jr_', l, event_id) FROM events, (SELECT unnest(['a', 'b']) AS l) WHERE event_id % 9 = 5""",
)
def stream_event_decoding(d: Data) -> DataFrame:
    home = scratch_path(d.spark, "messages")
    _messages(d).write.json(home)
    stream = flow.source(d.spark, "json", schema="at bigint, value string", path=home)
    return _drained(d, events.decode(stream), "decoded")


@query("stream_event_quarantine", "SELECT event_id AS at FROM events WHERE event_id % 9 = 7")
def stream_event_quarantine(d: Data) -> DataFrame:
    return events.broken(_messages(d)).select("at")


# Updates (an order has four at most) that a file of them holds about, and files that a batch takes at most.
FILE_UPDATES, BATCH_FILES = 1_000_000, 16


@query(
    "stream_latest_run",
    """SELECT job, run_id, state, started_on, completed_on, execution_time FROM run_updates
       QUALIFY row_number() OVER (PARTITION BY job ORDER BY started_on DESC, seq DESC, run_id DESC) = 1""",
    "run_updates",
)
def stream_latest_run(d: Data) -> DataFrame:
    # In several batches, so that the state is carried over them; all updates of a run are in one file.
    seq = F.col("seq") * F.lit(10**12) + F.substring("run_id", 4, 20).cast("bigint")
    home = scratch_path(d.spark, "updates")
    files = max(4, -(-4 * d.orders.count() // FILE_UPDATES))
    _updates(d, seq).repartition(files, "run_id").write.parquet(home)
    told = _drained(d, state.run_changes(_update_stream(d, home, min(BATCH_FILES, files // 4))), "latest")
    return _ntz(state.current(told).drop("seq", "change", "step", "told"), "started_on", "completed_on")


def _updates(d: Data, seq: Column) -> DataFrame:
    zoned = [F.col(c).cast("timestamp").alias(c) for c in ("started_on", "completed_on")]
    return d.run_updates.select("job", "run_id", "state", *zoned, "execution_time", seq.alias("seq"))


def _update_stream(d: Data, home: str, files_per_batch: int | None = None) -> DataFrame:
    return flow.source(d.spark, "parquet", schema=state.SCHEMA, path=home, files_per_batch=files_per_batch)


# Updates in the order in which they are seen; of those seen in one minute, by run.
SEEN = "(epoch_us(seen_on) // 60000000) * 100000000000 + CAST(substr(run_id, 4) AS BIGINT) * 4 + seq - 1"


@query(
    "stream_run_changes",
    f"""WITH u AS (SELECT * EXCLUDE (seq, seen_on), {SEEN} AS seq FROM run_updates),
         o AS (SELECT *, max(started_on) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_start FROM u),
         n AS (SELECT *, lag(run_id) OVER w AS r, lag(state) OVER w AS s, lag(completed_on) OVER w AS c, lag(execution_time) OVER w AS e
           FROM o WHERE held_start IS NULL OR started_on >= held_start WINDOW w AS (PARTITION BY job ORDER BY seq))
       SELECT job, run_id, state, started_on, completed_on, execution_time, seq, row_number() OVER (PARTITION BY job ORDER BY seq) AS change
       FROM n WHERE r IS DISTINCT FROM run_id OR s IS DISTINCT FROM state OR c IS DISTINCT FROM completed_on
         OR (state NOT IN ('STARTING', 'RUNNING', 'STOPPING', 'WAITING') AND e IS DISTINCT FROM execution_time)""",
    "run_updates",
)
def stream_run_changes(d: Data) -> DataFrame:
    """The updates arrive in three parts by time, each a batch; a job's runs start and end many times in each."""
    home = scratch_path(d.spark, "seen")
    seen = F.expr("unix_micros(CAST(seen_on AS TIMESTAMP)) div 60000000")
    seq = seen * F.lit(100_000_000_000) + F.substring("run_id", 4, 20).cast("bigint") * 4 + F.col("seq") - 1
    updates = _updates(d, seq)
    mark, out = scratch_path(d.spark, "changes-checkpoint"), scratch_path(d.spark, "changes")
    cuts = [F.lit(t).cast("timestamp").cast("bigint") / 60 * 100_000_000_000 for t in ("1994-01-01", "1996-06-01")]
    for part in (F.col("seq") < cuts[0], F.col("seq").between(cuts[0], cuts[1]), F.col("seq") > cuts[1]):
        updates.where(part).write.mode("append").parquet(home)
        stream = state.run_changes(_update_stream(d, home))
        flow.load_new(stream, out, mark)
    told = d.spark.read.schema(stream.schema).parquet(out).where("told").drop("step", "told")
    return _ntz(told, "started_on", "completed_on")


WINDOW_SQL = """SELECT event_type, time_bucket(INTERVAL '6' HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '6' HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL '6' HOUR AS window_end, count(*) AS n FROM events GROUP BY ALL"""


@query("window_tumbling", WINDOW_SQL)
def window_tumbling(d: Data) -> DataFrame:
    return _ntz(windows.window_counts(d.events.select("ts", "event_type"), "ts", "6 hours", ["event_type"]), "window_start", "window_end")


# A stream gives out a window once the watermark has passed its end, so the last ones stay open.
CLOSED = "<= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL '1' HOUR"


@query("stream_window_tumbling", f"SELECT * FROM ({WINDOW_SQL}) w WHERE window_end {CLOSED}")
def stream_window_tumbling(d: Data) -> DataFrame:
    counted = windows.window_counts(_events(d).select("ts", "event_type"), "ts", "6 hours", ["event_type"], delay="1 hour")
    return _ntz(_drained(d, counted, "windows"), "window_start", "window_end")


@query(
    "window_sliding",
    """SELECT w AS window_start, w + INTERVAL '6' HOUR AS window_end, count(*) AS n
       FROM (SELECT unnest([time_bucket(INTERVAL '2' HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL '2' HOUR * k FOR k IN [0, 1, 2]]) AS w FROM events) GROUP BY ALL""",
)
def window_sliding(d: Data) -> DataFrame:
    return _ntz(windows.window_counts(d.events.select("ts"), "ts", "6 hours", slide="2 hours"), "window_start", "window_end")


SESSION_SQL = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL '3' HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '3' HOUR AS idle_at, count(*) AS n FROM s GROUP BY user_id, no"""


@query("session_idle", SESSION_SQL)
def session_idle(d: Data) -> DataFrame:
    return _ntz(windows.session_table(d.events, ["user_id"], "ts", 3 * 3600), "session_start", "idle_at")


@query("stream_session_idle", f"SELECT * FROM ({SESSION_SQL}) s WHERE idle_at {CLOSED}")
def stream_session_idle(d: Data) -> DataFrame:
    sessions = windows.session_stream(_events(d).select("user_id", "ts"), ["user_id"], "ts", "3 hours", delay="1 hour")
    return _ntz(_drained(d, sessions, "sessions"), "session_start", "idle_at")


@query(
    "stream_log_follow",
    f"""SELECT event_id, run_id, id FROM logs JOIN (VALUES {RULES_SQL}) r(no, id, pattern, unless, confidence)
        ON regexp_matches(regexp_replace(message, '\\bo[0-9]{{2,}}\\b', 'o…', 'g'), pattern, 'i')
          AND (unless IS NULL OR NOT regexp_matches(regexp_replace(message, '\\bo[0-9]{{2,}}\\b', 'o…', 'g'), unless, 'i')) WHERE NOT ends_with(stream, '-progress-bar') AND NOT contains(stream, 'job-insights')""",
    "logs",
)
def stream_log_follow(d: Data) -> DataFrame:
    home = scratch_path(d.spark, "log-lines")
    lines = d.logs
    lines.write.parquet(home)
    stream = logs.console_lines(flow.source(d.spark, "parquet", schema=lines.schema, path=home))
    text = F.regexp_replace("message", sig.HANDLE, sig.HANDLE_MARK)
    hits = logs.line_hits(stream.select("event_id", "run_id", text.alias("line")), "line")
    named = F.element_at(F.array(*[F.lit(r.id) for r in sig.SIGNATURES]), F.col("rule") + 1)
    return _drained(d, hits.select("event_id", "run_id", named.alias("id")), "followed")


@query(
    "stream_log_follow_runs",
    f"""WITH e AS (SELECT run_id, ts, event_id, regexp_replace(message, '\\bo[0-9]{{2,}}\\b', 'o…', 'g') AS line,
           CASE WHEN ts - lag(ts) OVER w > INTERVAL '6' HOUR THEN 1 ELSE 0 END AS opens FROM logs
           WHERE NOT ends_with(stream, '-progress-bar') AND NOT contains(stream, 'job-insights') WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
         s AS (SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS no FROM e),
         over AS (SELECT run_id, no, min(ts) AS opened, max(ts) + INTERVAL '6' HOUR AS idle_at, lead(no) OVER (PARTITION BY run_id ORDER BY no) AS later FROM s GROUP BY run_id, no),
         r AS (SELECT * FROM (VALUES {RULES_SQL}) r(no, id, pattern, unless, confidence)),
         hits AS (SELECT run_id, s.no, id, min((ts, event_id)) AS first FROM s JOIN r ON regexp_matches(line, pattern, 'i') GROUP BY ALL),
         excluded AS (SELECT DISTINCT run_id, s.no, id FROM s JOIN r ON unless IS NOT NULL AND regexp_matches(line, unless, 'i'))
       SELECT o.run_id, opened, id, first[2] AS event_id, first[1] AS at FROM hits h JOIN over o ON o.run_id = h.run_id AND o.no = h.no
       WHERE (later IS NOT NULL OR idle_at {CLOSED}) AND NOT EXISTS (SELECT 1 FROM excluded x WHERE x.run_id = h.run_id AND x.no = h.no AND x.id = h.id)""",
    "logs",
)
def stream_log_follow_runs(d: Data) -> DataFrame:
    """A run is over after six silent hours; only then is it known what excludes what."""
    home = scratch_path(d.spark, "followed-lines")
    # In as many files as the cores can take, since many patterns are tried on every line.
    lines = d.logs.repartition("event_id")
    lines.write.parquet(home)
    stream = logs.console_lines(flow.source(d.spark, "parquet", schema=lines.schema, path=home))
    text = F.regexp_replace("message", sig.HANDLE, sig.HANDLE_MARK)
    found = followed.run_signatures(stream.select("run_id", "ts", "event_id", text.alias("line")), 6 * 3600, "1 hour")
    return _ntz(_drained(d, found, "followed-runs"), "opened", "at")


@query(
    "stream_incremental_load",
    """SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus""",
)
def stream_incremental_load(d: Data) -> DataFrame:
    drop, out, mark = (scratch_path(d.spark, n) for n in ("drop", "drop-loaded", "drop-checkpoint"))
    narrow = d.orders.select("o_orderkey", "o_orderstatus")
    for part in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus = 'P'"):
        narrow.where(part).write.mode("append").parquet(drop)
        flow.load_new(flow.source(d.spark, "parquet", schema=narrow.schema, path=drop), out, mark)
    loaded = sources.parquet(d.spark, out, schema=narrow.schema)
    return loaded.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("stream_dedup", "SELECT DISTINCT run_id, state, completed_on FROM run_updates", "run_updates")
def stream_dedup(d: Data) -> DataFrame:
    home = scratch_path(d.spark, "repeats")
    updates = d.run_updates.select("run_id", "state", "completed_on", "seen_on")
    updates.write.parquet(home)
    stream = flow.source(d.spark, "parquet", schema=updates.schema, path=home)
    once = windows.drop_repeats(stream, ["run_id", "state", "completed_on"], "seen_on", delay="12 hours")
    return _drained(d, once.select("run_id", "state", "completed_on"), "once")
