"""Run, log, metric, graph and NULL-bearing tables derived from the given ones.

Each text runs unchanged on Spark and on DuckDB; the tuple after it names the tables it reads.
"""

from __future__ import annotations

RUNS = """
SELECT concat('job_', CAST(o_custkey % 20 AS VARCHAR(20))) AS job,
  concat('jr_', CAST(o_orderkey AS VARCHAR(20))) AS run_id,
  CASE o_orderkey % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'STOPPED'
    WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'ERROR' ELSE 'SUCCEEDED' END AS state,
  o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 AS INTEGER) AS started_on,
  CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE CAST(o_orderkey % 7200 AS INTEGER) END AS execution_time,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 5000 AS DOUBLE) END AS dpu_seconds,
  CASE o_orderkey % 7 WHEN 0 THEN 'G.025X' WHEN 1 THEN 'G.1X' WHEN 2 THEN 'G.2X'
    WHEN 3 THEN 'Z.2X' WHEN 4 THEN 'G.4X' WHEN 5 THEN 'G.8X' END AS worker_type,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(2 + o_orderkey % 9 AS INTEGER) END AS number_of_workers,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 10.0E0 END AS max_capacity,
  CASE o_custkey % 4 WHEN 0 THEN 'gluestreaming' WHEN 1 THEN 'pythonshell'
    WHEN 2 THEN 'glueray' ELSE 'glueetl' END AS command_name
FROM orders
"""

LOGS = """
SELECT event_id, ts, concat('jr_', CAST(user_id AS VARCHAR(20))) AS run_id,
  CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'output' ELSE 'logs-v2' END AS log_group,
  CASE event_id % 5 WHEN 0 THEN 'driver-progress-bar' WHEN 1 THEN 'job-insights-rca-driver'
    WHEN 2 THEN 'g-exec1' WHEN 3 THEN 'job-insights-rule-driver' ELSE 'driver' END AS stream,
  CASE event_id % 8 WHEN 0 THEN concat('ERROR No space left on device on /mnt/', event_type)
    WHEN 1 THEN concat('An error occurred while calling o', CAST(event_id + 100 AS VARCHAR(20)),
                       '.pyWriteDynamicFrame. Illegal empty schema')
    WHEN 2 THEN 'Command failed with exit code 1' WHEN 3 THEN 'ThrottlingException: Rate exceeded'
    ELSE concat('INFO ', event_type, ' ', props) END AS message
FROM events
"""

METRICS = """
SELECT concat('jr_', CAST(user_id AS VARCHAR(20))) AS run_id,
  CASE event_type WHEN 'click' THEN 'bytesRead' WHEN 'view' THEN 'driverHeap'
    WHEN 'purchase' THEN 'activeExecutors' WHEN 'signup' THEN 'completedTasks'
    ELSE 'recordsRead' END AS metric, ts, value
FROM events
"""

EDGES = """
SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS src, CAST(100000000 + l_partkey AS BIGINT) AS dst
FROM lineitem WHERE l_linenumber = 1
UNION
SELECT DISTINCT CAST(100000000 + l_partkey AS BIGINT), CAST(10000000000 + l_orderkey AS BIGINT)
FROM lineitem WHERE l_linenumber = 1
"""

# The same graph with a way back from the orders of the lowest suppliers, so that it holds cycles.
CYCLIC_EDGES = """
SELECT src, dst FROM edges
UNION
SELECT CAST(10000000000 + l_orderkey AS BIGINT), CAST(l_suppkey AS BIGINT)
FROM lineitem WHERE l_linenumber = 1 AND l_suppkey < 2
"""

NULLS = """
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE o_orderkey % 6 WHEN 0 THEN 'x1' WHEN 1 THEN '' WHEN 2 THEN NULL
    ELSE CAST(o_custkey AS VARCHAR(20)) END AS code
FROM orders
"""

# One script per order, of one to eight lines; the lines come and go with the keys of the order.
SCRIPTS = """
SELECT concat('job_', CAST(o_orderkey AS VARCHAR(20)), '.py') AS script,
  concat_ws('\n', 'import sys',
    CASE WHEN o_orderkey % 2 = 0 THEN 'from pyspark.sql.functions import *' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'pdf = df.toPandas()' END,
    CASE WHEN o_custkey % 4 = 0 THEN 'spark.conf.set("spark.sql.legacy.timeParserPolicy", "LEGACY")' END,
    CASE WHEN o_custkey % 5 = 0 THEN 'DataSource0 = glueContext.create_dynamic_frame_from_catalog(database="d")' END,
    CASE WHEN o_custkey % 6 = 0 THEN 'python_version = "2.7"' END,
    CASE WHEN o_orderstatus = 'F' THEN 'sc = SparkContext()' END,
    CASE WHEN o_orderstatus = 'P' THEN 'write(df, format="glueparquet")' END) AS text
FROM orders
"""

# Every run reported up to three times: on start, once more unchanged, and when it ended.
RUN_UPDATES = """
SELECT job, run_id, started_on, 'RUNNING' AS state, CAST(NULL AS TIMESTAMP) AS completed_on,
  CAST(0 AS INTEGER) AS execution_time, CAST(1 AS BIGINT) AS seq, started_on AS seen_on FROM runs
UNION ALL
SELECT job, run_id, started_on, 'RUNNING', CAST(NULL AS TIMESTAMP), CAST(60 AS INTEGER), CAST(2 AS BIGINT),
  started_on + INTERVAL '1' MINUTE FROM runs
UNION ALL
SELECT job, run_id, started_on, state, started_on + INTERVAL '1' SECOND * execution_time, execution_time,
  CAST(3 AS BIGINT), started_on + INTERVAL '3' HOUR FROM runs WHERE state <> 'RUNNING'
UNION ALL
SELECT job, run_id, started_on, state, started_on + INTERVAL '1' SECOND * execution_time, execution_time,
  CAST(4 AS BIGINT), started_on + INTERVAL '4' HOUR FROM runs WHERE state <> 'RUNNING'
"""

# Every user is a session whose events are its statements.
SESSIONS = """
SELECT user_id AS session_id,
  CASE user_id % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'STOPPED' ELSE 'PROVISIONING' END AS status,
  CASE user_id % 5 WHEN 0 THEN 'G.025X' WHEN 1 THEN 'G.2X' WHEN 2 THEN 'R.4X' WHEN 3 THEN 'Z.2X' END AS worker_type,
  CASE WHEN user_id % 4 > 0 THEN CAST(1 + user_id % 7 AS INTEGER) END AS number_of_workers,
  CASE WHEN user_id % 6 > 0 THEN CAST(30 + user_id % 90 AS INTEGER) END AS idle_timeout,
  CAST(count(*) * 60 AS DOUBLE) AS dpu_seconds, min(ts) AS created_on
FROM events GROUP BY user_id
"""

STATEMENTS = """
SELECT user_id AS session_id, ts AS started_on,
  CASE WHEN event_id % 4 > 0 THEN ts + INTERVAL '30' SECOND END AS completed_on
FROM events WHERE event_type <> 'signup'
"""

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "runs": (RUNS, ("orders",)),
    "logs": (LOGS, ("events",)),
    "metrics": (METRICS, ("events",)),
    "edges": (EDGES, ("lineitem",)),
    "cyclic_edges": (CYCLIC_EDGES, ("edges", "lineitem")),
    "nulls": (NULLS, ("orders",)),
    "scripts": (SCRIPTS, ("orders",)),
    "run_updates": (RUN_UPDATES, ("runs",)),
    "sessions": (SESSIONS, ("events",)),
    "statements": (STATEMENTS, ("events",)),
}
