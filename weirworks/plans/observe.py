"""Logs, failure signatures, script scans, test reports and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.functions import signatures as sig
from weirworks.operators import lineage, logs
from weirworks.plans.registry import Data, query
from weirworks.session import scratch_path

CONSOLE = "NOT ends_with(stream, '-progress-bar') AND NOT contains(stream, 'job-insights-rca-driver') AND NOT contains(stream, 'job-insights-rule-driver')"


@query(
    "log_tail",
    f"""SELECT run_id, event_id, message FROM logs WHERE {CONSOLE}
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) <= 20""",
    "logs",
)
def log_tail(d: Data) -> DataFrame:
    return logs.tail(d.logs, 20).select("run_id", "event_id", "message")


@query("log_tail_one_run", f"SELECT event_id, ts, message FROM logs WHERE run_id = 'jr_1' AND log_group = 'error' AND {CONSOLE} ORDER BY ts DESC, event_id DESC LIMIT 5", "logs")
def log_tail_one_run(d: Data) -> DataFrame:
    return logs.tail_of(d.logs, "jr_1", 5, "error").select("event_id", "ts", "message")


@query(
    "log_search",
    "SELECT event_id, message, regexp_matches(message, 'ERROR|Exception|Traceback') AS is_error FROM logs WHERE contains(lower(message), 'or')",
    "logs",
)
def log_search(d: Data) -> DataFrame:
    return logs.search(d.logs, "OR").select("event_id", "message", "is_error")


@query(
    "log_insights",
    """SELECT event_id, run_id, CASE WHEN contains(stream, 'rca') THEN 'rootCause' ELSE 'guidance' END AS insight, message FROM logs
       WHERE log_group IN ('error', 'logs-v2') AND contains(stream, 'job-insights')
       QUALIFY row_number() OVER (PARTITION BY run_id, log_group, stream ORDER BY ts, event_id) <= 500""",
    "logs",
)
def log_insights(d: Data) -> DataFrame:
    return logs.insights(d.logs).select("event_id", "run_id", "insight", "message")


FAILURES = """SELECT run_id, state, CASE state WHEN 'TIMEOUT' THEN concat('Execution timed out after ', CAST(execution_time AS VARCHAR(20)), ' s')
    WHEN 'ERROR' THEN concat('first line', chr(10), 'Command failed with exit code 137', chr(10), 'AnalysisException: UNRESOLVED_COLUMN ', run_id)
    WHEN 'STOPPED' THEN 'stopped by hand' END AS error_message FROM runs WHERE state IN ('FAILED', 'TIMEOUT', 'ERROR', 'STOPPED')"""


def failures(d: Data) -> DataFrame:
    d.wide("runs", "run_id").createOrReplaceTempView("runs")
    return d.spark.sql(FAILURES)


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


RULES_SQL = ", ".join(f"({i}, {_literal(r.id)}, {_literal(r.pattern)}, {_literal(r.unless)}, {r.confidence})" for i, r in enumerate(sig.SIGNATURES))
LINES_SQL = f"""failures AS ({FAILURES}),
  tails AS (SELECT run_id, ts, event_id, message FROM logs WHERE log_group = 'error' AND {CONSOLE} AND run_id IN (SELECT run_id FROM failures)),
  texts AS (SELECT run_id, 0 AS part, NULL AS ts, 0 AS event_id, error_message AS text FROM failures WHERE error_message IS NOT NULL
    UNION ALL SELECT run_id, 1, ts, event_id, message FROM tails UNION ALL SELECT run_id, 2, NULL, 0, concat('STATE=', state) FROM failures),
  lines AS (SELECT run_id, part, ts, event_id, line_no, regexp_replace(line, '\\bo[0-9]{{2,}}\\b', 'o…', 'g') AS line FROM
    (SELECT run_id, part, ts, event_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM texts))"""


@query(
    "failure_signatures",
    f"""WITH {LINES_SQL},
       rules AS (SELECT * FROM (VALUES {RULES_SQL}) r(no, id, pattern, unless, confidence)),
       hits AS (SELECT run_id, no, arg_min(line, (part, coalesce(ts, TIMESTAMP '1970-01-01'), event_id, line_no)) AS evidence
         FROM lines JOIN rules ON regexp_matches(line, pattern, 'i') GROUP BY run_id, no),
       excluded AS (SELECT DISTINCT run_id, no FROM lines JOIN rules ON unless IS NOT NULL AND regexp_matches(line, unless, 'i'))
       SELECT h.run_id, r.id, CAST(r.confidence AS DOUBLE) AS confidence, trim(h.evidence) AS evidence,
         CAST(row_number() OVER (PARTITION BY h.run_id ORDER BY r.confidence DESC, r.no) AS INTEGER) AS rank
       FROM hits h JOIN rules r ON h.no = r.no WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.run_id = h.run_id AND e.no = h.no)""",
    "runs", "logs",
)
def failure_signatures(d: Data) -> DataFrame:
    found = logs.classify(logs.evidence_lines(failures(d), d.logs))
    return found.select("run_id", "id", "confidence", "evidence", "rank")


@query(
    "failures_unclassified",
    f"""WITH {LINES_SQL},
       rules AS (SELECT * FROM (VALUES {RULES_SQL}) r(no, id, pattern, unless, confidence)),
       known AS (SELECT DISTINCT l.run_id FROM lines l JOIN rules r ON regexp_matches(line, pattern, 'i')
         WHERE NOT EXISTS (SELECT 1 FROM lines e WHERE r.unless IS NOT NULL AND e.run_id = l.run_id AND regexp_matches(e.line, r.unless, 'i')))
       SELECT regexp_replace(line, '[0-9]+', '#', 'g') AS shape, count(*) AS n FROM lines WHERE run_id NOT IN (SELECT run_id FROM known) GROUP BY 1""",
    "runs", "logs",
)
def failures_unclassified(d: Data) -> DataFrame:
    failed = failures(d)
    lines = logs.evidence_lines(failed, d.logs)
    unknown = logs.unclassified(failed, logs.classify(lines))
    return logs.message_shapes(lines.join(unknown.select("run_id"), "run_id", "leftsemi"))


SCAN_SQL = ", ".join(f"({_literal(r.pattern)}, {_literal(r.severity)}, {_literal(r.title)})" for r in sig.MIGRATION_RULES)


@query(
    "script_migration_scan",
    f"""WITH rules AS (SELECT * FROM (VALUES {SCAN_SQL}) r(pattern, severity, title)),
       lines AS (SELECT script, unnest(string_split(text, chr(10))) AS code, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line FROM scripts)
       SELECT script, line, severity, title FROM lines JOIN rules ON regexp_matches(code, pattern)""",
    "scripts",
)
def script_migration_scan(d: Data) -> DataFrame:
    return logs.scan_scripts(d.wide("scripts", "script"))


@query(
    "script_severity_counts",
    f"""WITH rules AS (SELECT * FROM (VALUES {SCAN_SQL}) r(pattern, severity, title)),
       lines AS (SELECT script, unnest(string_split(text, chr(10))) AS code FROM scripts)
       SELECT script, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info
       FROM lines JOIN rules ON regexp_matches(code, pattern) GROUP BY script""",
    "scripts",
)
def script_severity_counts(d: Data) -> DataFrame:
    return logs.severity_counts(logs.scan_scripts(d.wide("scripts", "script")))


@query(
    "test_report_cases",
    """SELECT concat('test_step_', CAST(o_custkey % 30 AS VARCHAR), '::test_order_', CAST(o_orderkey AS VARCHAR)) AS name, concat('step_', CAST(o_custkey % 30 AS VARCHAR)) AS node,
         CASE o_orderkey % 10 WHEN 0 THEN 'fail' WHEN 1 THEN 'error' WHEN 2 THEN 'skip' ELSE 'pass' END AS status,
         CASE o_orderkey % 10 WHEN 0 THEN concat('assert ', CAST(o_orderkey AS VARCHAR), ' == 0') WHEN 1 THEN concat('boom in ', o_orderpriority) WHEN 2 THEN 'no sample' END AS message,
         o_orderkey % 5000 AS ms FROM orders""",
)
def test_report_cases(d: Data) -> DataFrame:
    return _report_cases(d).drop("report")


@query(
    "test_report_summary",
    """WITH c AS (SELECT concat('step_', CAST(o_custkey % 30 AS VARCHAR)) AS node, o_orderkey % 10 AS k, o_orderkey % 5000 AS ms FROM orders),
         s AS (SELECT node, count(*) FILTER (k > 2) AS passed, count(*) FILTER (k = 0) AS failed, count(*) FILTER (k = 1) AS errors, count(*) FILTER (k = 2) AS skipped,
           CAST(sum(ms) AS BIGINT) AS ms FROM c GROUP BY node)
       SELECT node, passed, failed, errors, skipped, ms, CASE WHEN failed + errors > 0 THEN 'failed' ELSE 'passed' END AS status FROM s
       UNION ALL SELECT DISTINCT concat('idle_', r_name), 0, 0, 0, 0, 0, 'none' FROM region""",
)
def test_report_summary(d: Data) -> DataFrame:
    cases = _report_cases(d)
    listed = cases.select("node").union(d.region.select(F.concat(F.lit("idle_"), "r_name")))
    return logs.report_summary(cases, "node", listed)


def _report_cases(d: Data) -> DataFrame:
    key, no = F.col("o_orderkey"), F.lit(None).cast("string")

    def outcome(rest: int, message, body):
        return F.when(key % 10 == rest, F.struct(message.alias("_message"), body.alias("_VALUE")))

    cases = d.orders.select(
        F.format_string("tests.test_step_%d", F.col("o_custkey") % 30).alias("_classname"),
        F.format_string("test_order_%d", key).alias("_name"),
        F.format_string("%d.%03d", F.floor(key % 5000 / 1000), key % 1000).alias("_time"),
        outcome(0, F.format_string("assert %d == 0", key), F.lit("stack")).alias("failure"),
        outcome(1, no, F.concat(F.lit("boom in "), "o_orderpriority")).alias("error"),
        outcome(2, F.lit("no sample"), no).alias("skipped"),
    )
    out = scratch_path(d.spark, "reports")
    cases.write.format("xml").option("rootTag", "testsuite").option("rowTag", "testcase").save(out)
    return logs.read_test_reports(d.spark, out)


@query(
    "settings_mask_secrets",
    """SELECT event_id, '••••' AS api_key, props AS props, CASE WHEN event_type = 'click' THEN '••••' END AS db_password, '••••' AS "AuthToken" FROM events""",
)
def settings_mask_secrets(d: Data) -> DataFrame:
    def entry(name: str, value: str):
        return F.struct(F.lit(name).alias("k"), F.col(value).alias("v"))

    settings = F.map_from_entries(F.filter(F.array(
        entry("api_key", "props"), entry("props", "props"),
        F.when(F.col("event_type") == "click", entry("db_password", "props")), entry("AuthToken", "props"),
    ), lambda e: e.isNotNull()))
    masked = d.events.select("event_id", logs.mask_secrets(settings).alias("s"))
    return masked.select("event_id", *[F.try_element_at("s", F.lit(k)).alias(k) for k in ("api_key", "props", "db_password", "AuthToken")])


ANCHORS = "SELECT DISTINCT CAST(100000000 + l_partkey AS BIGINT) AS node FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 49 AND l_discount > 0.09"


def anchors(d: Data) -> DataFrame:
    d.lineitem.createOrReplaceTempView("lineitem")
    return d.spark.sql(ANCHORS)


REACH_SQL = f"""WITH RECURSIVE anchors AS ({ANCHORS}),
  down AS (SELECT node FROM anchors UNION SELECT e.dst FROM down JOIN edges e ON e.src = down.node),
  up AS (SELECT node FROM anchors UNION SELECT e.src FROM up JOIN edges e ON e.dst = up.node)"""


@query("lineage_nodes", f"{REACH_SQL} SELECT node FROM down UNION SELECT node FROM up", "edges")
def lineage_nodes(d: Data) -> DataFrame:
    return lineage.reachable(d.edges, anchors(d))[0]


@query(
    "lineage_edges",
    f"""{REACH_SQL} SELECT src, dst FROM edges WHERE src IN (SELECT node FROM down) UNION SELECT src, dst FROM edges WHERE dst IN (SELECT node FROM up)""",
    "edges",
)
def lineage_edges(d: Data) -> DataFrame:
    return lineage.reachable(d.edges, anchors(d))[1]


@query(
    "lineage_depth",
    """WITH RECURSIVE walk AS (SELECT src AS node, 0 AS depth FROM edges UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node)
       SELECT node, CAST(max(depth) AS INTEGER) AS depth FROM walk GROUP BY node""",
    "edges",
)
def lineage_depth(d: Data) -> DataFrame:
    return lineage.depths(d.edges)


# Paths without a cycle have at most three edges before, between and after the few ways back, so a walk of 40
# steps can only exist behind a cycle.
@query(
    "lineage_cycles",
    """WITH RECURSIVE walk AS (SELECT DISTINCT src AS node, 0 AS depth FROM cyclic_edges UNION SELECT dst, depth + 1 FROM walk JOIN cyclic_edges ON src = node WHERE depth < 40)
       SELECT DISTINCT node FROM walk WHERE depth = 40""",
    "cyclic_edges",
)
def lineage_cycles(d: Data) -> DataFrame:
    return lineage.cycle_nodes(d.cyclic_edges)


@query(
    "lineage_missing_sources",
    f"""WITH RECURSIVE anchors AS ({ANCHORS}),
         up AS (SELECT node FROM anchors UNION SELECT e.src FROM up JOIN edges e ON e.dst = up.node)
       SELECT node FROM up WHERE node IN (SELECT s_suppkey FROM supplier) AND node NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)""",
    "edges",
)
def lineage_missing_sources(d: Data) -> DataFrame:
    sources = d.supplier.select(F.col("s_suppkey").alias("node"))
    manifest = d.supplier.where("s_acctbal > 9000").select(F.col("s_suppkey").alias("node"))
    return lineage.missing_sources(d.edges, anchors(d), sources, manifest)
