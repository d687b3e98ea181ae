"""Log tails, search, insights, failure signatures, script scans and test reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirworks.functions import signatures as sig
from weirworks.operators.ordered import top_per_key


def _insight(stream: Column) -> Column:
    return reduce(lambda a, b: a | b, [stream.contains(s) for s in sig.INSIGHT_STREAMS])


def console_lines(logs: DataFrame, group: str = "all") -> DataFrame:
    """Lines of the console streams: progress bars and insight streams are left out."""
    stream = F.col("stream")
    out = logs.where(~stream.endswith(sig.PROGRESS_SUFFIX) & ~_insight(stream))
    return out if group == "all" else out.where(F.col("log_group") == group)


def tail(logs: DataFrame, n: int, group: str = "all") -> DataFrame:
    """The last ``n`` console lines of every run, over all its streams."""
    newest = [F.desc("ts"), F.desc("event_id")]
    return top_per_key(console_lines(logs, group), ["run_id"], newest, n)


def tail_of(logs: DataFrame, run_id: str, n: int, group: str = "all") -> DataFrame:
    """The last ``n`` console lines of one run, oldest first."""
    lines = console_lines(logs.where(F.col("run_id") == run_id), group)
    return lines.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).orderBy("ts", "event_id")


def search(logs: DataFrame, text: str) -> DataFrame:
    """Lines holding the text in any case, with a mark on those that look like errors."""
    found = logs.where(F.lower("message").contains(text.lower()))
    return found.withColumn("is_error", F.col("message").rlike(sig.ERROR_WORDS))


def insights(logs: DataFrame, lines_each: int | None = None) -> DataFrame:
    """The lines of every insight stream (all, or the first of each), tagged with what they hold."""
    tag = F.lit(None).cast("string")
    for stream, name in sig.INSIGHT_STREAMS.items():
        tag = F.when(F.col("stream").contains(stream), name).otherwise(tag)
    lines = logs.where(F.col("log_group").isin(*sig.INSIGHT_GROUPS) & _insight(F.col("stream")))
    if lines_each is not None:
        lines = top_per_key(lines, ["run_id", "log_group", "stream"], [F.asc("ts"), F.asc("event_id")], lines_each)
    return lines.withColumn("insight", tag)


def rule_marks(text: Column, rules: Sequence[sig.Signature] = sig.SIGNATURES) -> Column:
    """One entry per pattern of every rule: ``(rule, excludes)`` where it occurs in the line, else NULL.

    Meant to be exploded: each pattern is then tried once per line, inside generated code.
    """
    marks = []
    for number, rule in enumerate(rules):
        marks.append(_mark(text, rule.pattern, number, False))
        if rule.unless:
            marks.append(_mark(text, rule.unless, number, True))
    return F.array(*marks)


def _mark(text: Column, pattern: str, number: int, excludes: bool) -> Column:
    return F.when(text.rlike("(?i)" + pattern), F.struct(F.lit(number).alias("rule"), F.lit(excludes).alias("excludes")))


def rule_hits(lines: DataFrame, text: str, rules: Sequence[sig.Signature] = sig.SIGNATURES) -> DataFrame:
    """A row ``(..., rule, excludes)`` for every pattern that occurs in a line."""
    # Most lines hit nothing: one pattern that holds them all is tried first.
    any_rule = "(?i)" + "|".join(f"(?:{p})" for r in rules for p in (r.pattern, r.unless) if p)
    marks = F.filter(rule_marks(F.col(text), rules), lambda m: m.isNotNull())
    return lines.where(F.col(text).rlike(any_rule)).select(*[F.col(f"`{c}`") for c in lines.columns], F.inline(marks))


def line_hits(lines: DataFrame, text: str, rules: Sequence[sig.Signature] = sig.SIGNATURES) -> DataFrame:
    """A row ``(..., rule)`` for every rule that a line meets and whose exclusion it doesn't meet, for lines on their own."""
    any_rule = "(?i)" + "|".join(f"(?:{r.pattern})" for r in rules)
    marked = lines.where(F.col(text).rlike(any_rule)).withColumn("_marks", F.filter(rule_marks(F.col(text), rules), lambda m: m.isNotNull()))
    excluded = F.transform(F.filter("_marks", lambda m: m["excludes"]), lambda m: m["rule"])
    rules_met = F.array_except(F.transform(F.filter("_marks", lambda m: ~m["excludes"]), lambda m: m["rule"]), excluded)
    return marked.select(*[F.col(f"`{c}`") for c in lines.columns], F.explode(rules_met).alias("rule"))


def evidence_lines(failures: DataFrame, logs: DataFrame, last: int | None = None) -> DataFrame:
    """The text of each failed run, line by line: its message, its error log (all, or the ``last`` lines), its state."""
    said = failures.where("error_message IS NOT NULL").select(
        "run_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("seq"), F.col("error_message").alias("text")
    )
    # Runs are listed once each, so both sides of this join come straight from their scans and AQE can split a
    # run with very many lines.
    ids = failures.select("run_id")
    theirs = logs.join(ids, "run_id", "leftsemi")
    logged = (console_lines(theirs, "error") if last is None else tail(theirs, last, "error")).select(
        "run_id", F.lit(1).alias("part"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.col("message").alias("text")
    )
    state = failures.where("state IS NOT NULL").select(
        "run_id", F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit("STATE="), "state").alias("text")
    )
    every = said.unionByName(logged).unionByName(state)
    split = every.select("run_id", "part", "at", "seq", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("line", F.regexp_replace("line", sig.HANDLE, sig.HANDLE_MARK))


def _short(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def classify(lines: DataFrame, rules: Sequence[sig.Signature] = sig.SIGNATURES, evidence_chars: int | None = None) -> DataFrame:
    """Rules that match each run, most confident first, with the first line that matched.

    All rules look at a line in one pass, and one aggregation keeps, per run and rule, the first hit and
    whether an exclusion was met anywhere in the run.
    """
    hits = rule_hits(lines.select("run_id", "part", "at", "seq", "line_no", "line"), "line", rules)
    place = F.when(~F.col("excludes"), F.struct("part", "at", "seq", "line_no", "line"))
    found = hits.groupBy("run_id", "rule").agg(F.min(place).alias("first"), F.max("excludes").alias("excluded"))
    found = found.where(F.col("first").isNotNull() & ~F.col("excluded"))
    line = F.btrim("first.line")
    table = lines.sparkSession.createDataFrame(
        [(i, r.id, r.confidence, r.cause, r.fix) for i, r in enumerate(rules)], "rule int, id string, confidence double, cause string, fix string"
    )
    named = found.join(F.broadcast(table), "rule")  # one row per rule
    best = Window.partitionBy("run_id").orderBy(F.desc("confidence"), "rule")
    return named.select(
        "run_id", "id", "confidence", "cause", "fix",
        _short(line, evidence_chars).alias("evidence"),
        F.row_number().over(best).alias("rank"),
    )


def unclassified(failures: DataFrame, matches: DataFrame) -> DataFrame:
    """Failed runs no rule explains."""
    return failures.join(matches.select("run_id").distinct(), "run_id", "leftanti")


def message_shapes(lines: DataFrame, column: str = "line") -> DataFrame:
    """How often each message occurs once its numbers are taken out, to find new rules."""
    shape = F.regexp_replace(F.regexp_replace(F.col(column), sig.HANDLE, sig.HANDLE_MARK), r"[0-9]+", "#")
    return lines.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def scan_scripts(scripts: DataFrame) -> DataFrame:
    """Migration findings ``(script, line, severity, title)`` over ``(script, text)`` rows.

    One pattern that holds all rules is tried first, on whole scripts and then on their lines: most have no finding.
    """
    any_rule = "|".join(f"(?:{r.pattern})" for r in sig.MIGRATION_RULES)
    scripts = scripts.where(F.col("text").rlike("(?m)" + any_rule))
    lines = scripts.select("script", F.posexplode(F.split("text", "\n")).alias("_at", "code"))
    marks = [
        F.when(F.col("code").rlike(r.pattern), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title")))
        for r in sig.MIGRATION_RULES
    ]
    found = F.filter(F.array(*marks), lambda m: m.isNotNull())
    return lines.where(F.col("code").rlike(any_rule)).select("script", (F.col("_at") + 1).alias("line"), F.inline(found))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per script and severity, one row per script."""
    return findings.groupBy("script").pivot("severity", ["error", "warn", "info"]).agg(F.count(F.lit(1))).fillna(0)


# Outcome elements of a test case in the order they are looked for, and the status each gives.
OUTCOMES = {"failure": "fail", "error": "error", "skipped": "skip"}

_OUTCOME = "array<struct<_message string, _VALUE string>>"
_CASE_SCHEMA = f"_classname string, _name string, _time string, failure {_OUTCOME}, error {_OUTCOME}, skipped {_OUTCOME}"


def read_test_reports(spark: SparkSession, paths: str | Sequence[str], message_chars: int | None = None) -> DataFrame:
    """JUnit XML reports as ``(report, name, node, status, message, ms)``, one row per test case."""
    raw = (
        spark.read.format("xml").option("rowTag", "testcase").option("recursiveFileLookup", True)
        .schema(_CASE_SCHEMA).load([paths] if isinstance(paths, str) else list(paths))
    )
    status, message = F.lit("pass"), F.lit(None).cast("string")
    for element, word in reversed(OUTCOMES.items()):
        there = F.size(F.col(element)) > 0
        first = F.get(element, F.lit(0))
        said = F.when(F.length(first["_message"]) > 0, first["_message"]).otherwise(F.btrim(F.coalesce(first["_VALUE"], F.lit(""))))
        status = F.when(there, word).otherwise(status)
        message = F.when(there, said).otherwise(message)
    suite = F.regexp_replace(F.coalesce("_classname", F.lit("")), r"^tests\.", "")
    title = F.when(F.coalesce("_classname", F.lit("")) == "", F.col("_name")).otherwise(F.concat(suite, F.lit("::"), F.col("_name")))
    return raw.select(
        F.col("_metadata.file_path").alias("report"), title.alias("name"), F.regexp_replace(suite, "^test_", "").alias("node"),
        status.alias("status"), _short(message, message_chars).alias("message"),
        F.floor(F.coalesce(F.col("_time").try_cast("double"), F.lit(0.0)) * 1000 + 0.5).alias("ms"),
    )


def report_summary(cases: DataFrame, by: str = "report", reports: DataFrame | None = None) -> DataFrame:
    """Counts per outcome and one overall status for every report; of the ``reports`` listed, those without a case too."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = (
        cases.groupBy(by)
        .agg(count("pass").alias("passed"), count("fail").alias("failed"), count("error").alias("errors"), count("skip").alias("skipped"), F.sum("ms").alias("ms"))
        .withColumn("status", F.when(F.col("failed") + F.col("errors") > 0, "failed").otherwise("passed"))
    )
    if reports is None:
        return out
    every = reports.select(by).distinct().join(out, by, "left")
    return every.fillna(0, ["passed", "failed", "errors", "skipped", "ms"]).fillna("none", ["status"])


def mask_secrets(settings: Column) -> Column:
    """A map column with the values of secret-looking keys hidden."""
    return F.transform_values(settings, lambda k, v: F.when(k.rlike(sig.SECRET_KEY), F.lit(sig.SECRET_MASK)).otherwise(v))
