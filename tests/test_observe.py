import datetime as dt
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirworks.functions import runs as fx
from weirworks.functions import search, signatures
from weirworks.operators.name_index import NameIndex
from weirworks.operators import lineage, logs, metrics, runs

LOGS = "run_id string, ts timestamp_ntz, event_id bigint, log_group string, stream string, message string"
FAILED = "run_id string, state string, error_message string"


def explain(spark, message, log=(), last=None):
    """Rule ids and evidence of one failed run."""
    at = dt.datetime(2026, 1, 1)
    lines = [("r", at + dt.timedelta(seconds=i), i, "error", "driver", text) for i, text in enumerate(log)]
    failed = spark.createDataFrame([("r", "FAILED", message)], FAILED)
    found = logs.classify(logs.evidence_lines(failed, spark.createDataFrame(lines, LOGS), last))
    return {r.id: r.evidence for r in found.orderBy("rank").collect()}


# One log line per rule, and the rules it must meet, most confident first.
CAUSES = {
    "writer does not support writing empty or nested empty schemas": ["empty-read"],
    "nightly: GC overhead limit, java.lang.OutOfMemoryError: GC overhead in the driver": ["driver-oom"],
    "task 9 failed: No space left on device (/var/shuffle)": ["disk-not-memory"],
    "loader is not authorized to perform: iam:PassRole on role/etl": ["passrole"],
    "VPC S3 endpoint validation failed for subnet-7": ["vpc-endpoint"],
    "column town cannot be resolved in step 4": ["unresolved-column"],
    "Py4JJavaError in step 2": ["py4j-wall"],
    "ThrottlingException in page 14": ["throttling"],
    "all went well": [],
}


def test_lines_name_their_rules(spark):
    failed = spark.createDataFrame([(line, "FAILED", f"step 1 done\n{line}\nbye") for line in CAUSES], FAILED)
    found = logs.classify(logs.evidence_lines(failed, spark.createDataFrame([], LOGS))).collect()
    for line, wanted in CAUSES.items():
        assert set(wanted) <= {r.id for r in found if r.run_id == line}
        assert wanted or line not in {r.run_id for r in found}


def test_wrapper_messages_give_way(spark):
    assert list(explain(spark, "Command failed with exit code 137")) == ["exit-code"]
    assert "exit-code" not in explain(spark, "Command failed with exit code 137", ["worker 3: No space left on device"])


def test_exclusions_count_anywhere_in_the_run(spark):
    assert "access-denied" in explain(spark, "Access Denied on the bucket")
    assert "access-denied" not in explain(spark, "Access Denied on the bucket", ["wrote to temporary folder"])


def test_evidence_is_the_first_line_normalised_stripped_and_cut(spark):
    one = explain(spark, None, ["INFO before", "  ERROR No space left on device on /mnt/tmp  ", "INFO after", "No space left on device again"])
    assert one["disk-not-memory"] == "ERROR No space left on device on /mnt/tmp"
    assert "o…" in explain(spark, "An error occurred while calling o98765.getDynamicFrame")["py4j-wall"]
    long = explain(spark, "first line\nNo space left on device " + "x" * 500)["disk-not-memory"]
    assert len(long) == len("No space left on device ") + 500
    assert explain(spark, "Rate exceeded (message)", ["Rate exceeded (log)"])["throttling"] == "Rate exceeded (message)"


def test_every_error_line_counts_unless_a_tail_is_asked_for(spark):
    noise = ["Rate exceeded"] + ["fine"] * 700
    assert "throttling" in explain(spark, None, noise)
    assert "throttling" not in explain(spark, None, noise, last=700)


def test_rules_are_complete():
    assert len(signatures.SIGNATURES) == 29 == len({r.id for r in signatures.SIGNATURES})
    assert len(signatures.MIGRATION_RULES) == 11
    assert all(r.cause and r.fix and 0.1 <= r.confidence <= 1 for r in signatures.SIGNATURES)


# Two springs feed one brook; a pond of its own drains into a marsh.
EDGES = [("brook", "river"), ("pond", "marsh"), ("river", "sea"), ("spring", "brook"), ("well", "brook"), ("river", "canal")]


@pytest.mark.parametrize(
    "anchors, missing",
    [
        (["river"], {"pond", "marsh"}), (["spring"], {"well", "pond", "marsh"}), (["sea"], {"canal", "pond", "marsh"}),
        (["canal", "marsh"], {"sea"}), ([], {"brook", "river", "sea", "spring", "well", "canal", "pond", "marsh"}),
    ],
)
def test_neighbourhoods(spark, anchors, missing):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    seen, between = lineage.reachable(edges, spark.createDataFrame([(a,) for a in anchors], "node string"))
    nodes = {n for e in EDGES for n in e} - missing
    assert {r.node for r in seen.collect()} == nodes
    assert rows(between) == sorted(e for e in EDGES if set(e) <= nodes)


def test_rounds_write_what_they_touch(spark, monkeypatch):
    """On a chain beside many waiting nodes, rows written grow with the rounds, not with rounds times nodes."""
    written = []
    cut = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])

    def total(length):
        written.clear()
        chain = [(n, n + 1) for n in range(length)]
        fan = [(length, 1_000 + n) for n in range(300)] + [(0, 1_000 + n) for n in range(300)]
        found = {r.node: r.depth for r in lineage.depths(spark.createDataFrame(chain + fan, "src int, dst int")).collect()}
        assert found == {n: n for n in range(length + 1)} | {1_000 + n: length + 1 for n in range(300)}
        return sum(df.count() for df in written)

    assert total(12) - total(6) <= 6 * 12


def test_cycles_end_and_are_named(spark):
    edges = spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "z"), ("s", "x"), ("s", "t"), ("t", "u"), ("s", "u")], "src string, dst string")
    assert [r.node for r in lineage.reachable(edges, spark.createDataFrame([("x",)], "node string"))[0].orderBy("node").collect()] == ["s", "x", "y", "z"]
    assert rows(lineage.depths(edges).where("depth IS NOT NULL")) == [("s", 0), ("t", 1), ("u", 2)]
    assert rows(lineage.cycle_nodes(edges)) == [("x",), ("y",), ("z",)]


def test_long_chain_passes_the_compaction_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(19)], "src bigint, dst bigint")
    assert rows(lineage.depths(chain)) == sorted(((i, i) for i in range(20)), key=repr)
    assert lineage.reachable(chain, spark.createDataFrame([(0,)], "node bigint"))[0].count() == 20


SESSION = "session_id string, status string, worker_type string, number_of_workers int, idle_timeout int, dpu_seconds double, created_on timestamp_ntz"
NOON = dt.datetime(2026, 9, 2, 12)


def cost(spark, *session, used=None):
    sessions = spark.createDataFrame([("s", *session)], SESSION)
    statements = spark.createDataFrame([("s", None, used)] if used else [], "session_id string, started_on timestamp_ntz, completed_on timestamp_ntz")
    return runs.session_costs(sessions, statements, F.lit(NOON).cast("timestamp_ntz")).first()


def test_session_prices_and_idle_time(spark):
    early = NOON - dt.timedelta(hours=3)
    late = NOON - dt.timedelta(minutes=15)
    assert cost(spark, "READY", "G.1X", 2, 30, 3600.0, late).per_hour == pytest.approx(0.88)
    assert cost(spark, "READY", "G.8X", 10, 30, None, late).per_hour == pytest.approx(35.2)
    assert cost(spark, "READY", None, None, 30, None, late).units == 2
    assert cost(spark, "READY", "G.025X", 4, 30, 3600.0, late).spent == pytest.approx(0.44)
    assert cost(spark, "READY", "G.1X", 2, 30, None, early, used=NOON - dt.timedelta(minutes=10)).idle_minutes_left == 20
    assert cost(spark, "READY", "G.1X", 2, 30, None, late).idle_minutes_left == 15
    assert cost(spark, "READY", "G.1X", 2, 30, None, early).idle_minutes_left == 0
    assert cost(spark, "STOPPED", "G.1X", 2, 30, None, late).idle_minutes_left is None
    assert cost(spark, "READY", "G.1X", 2, 30, None, None).idle_minutes_left is None
    assert cost(spark, "READY", "G.1X", 2, None, None, late).idle_minutes_left is None


def test_run_cost_falls_back_step_by_step(spark):
    data = [(7200.0, 10, "G.1X", 5, None), (0.0, 3600, "G.2X", 5, None), (None, 3600, "G.025X", None, 8.0), (None, 3600, None, None, None), (None, None, "G.8X", 9, None)]
    df = spark.createDataFrame(data, "a double, b int, c string, d int, e double")
    got = [r.h for r in df.select(fx.unit_hours(*[F.col(c) for c in "abcde"]).alias("h")).collect()]
    assert got == [2.0, 10.0, 2.0, 2.0, 0.0]


def test_metric_slots_follow_the_span(spark):
    base = dt.datetime(2024, 1, 1)
    points = [("short", "bytesRead", base + dt.timedelta(seconds=30 * i), 1.0) for i in range(10)]
    points += [("long", "driverHeap", base + dt.timedelta(minutes=7 * i), float(i)) for i in range(100)]
    out = metrics.resample(spark.createDataFrame(points, "run_id string, metric string, ts timestamp_ntz, value double"))
    assert {(r.run_id, r.period) for r in out.collect()} == {("short", 60), ("long", 900)}
    assert sorted(r.value for r in out.where("run_id = 'short'").collect()) == [2.0] * 5
    assert len(metrics.SERIES) == 14


def edits(a, b):
    """Optimal string alignment distance."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=25, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.lists(st.text("abc", max_size=7), min_size=1, max_size=40), st.sampled_from([1, 2]))
def test_typo_distance_against_brute_force(spark, query, words, typos):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [bool(r.ok) for r in df.select(search.close_to(query, F.col("w"), typos).alias("ok")).collect()]
    assert got == [edits(query, w) <= typos for w in words]


def test_search_tiers(spark):
    table = [("CSV", "S3CsvSource", ["file"]), ("Drop Duplicates", "DropDuplicates", ["dedupe", "distinct"]), ("Apply Mapping", "ApplyMapping", ["cast"]),
             ("Filter", "Filter", ["where"]), ("Join", "Join", [])]
    df = spark.createDataFrame(table, "name string, type string, words array<string>")

    def find(q):
        scored = df.select("type", search.score(q, F.col("name"), F.col("type"), F.col("words")).alias("s"))
        return {r.type: r.s for r in scored.where("s IS NOT NULL").collect()}

    assert find("csv")["S3CsvSource"] == 1000
    assert find("cvs")["S3CsvSource"] == 550
    assert find("jion")["Join"] == 500 and find("aplpy")["ApplyMapping"] == 500
    assert find("dup")["DropDuplicates"] == 895
    assert find("source") == {"S3CsvSource": 800}
    assert find("dedupe")["DropDuplicates"] == 780 and find("ded")["DropDuplicates"] == 760 and find("stinct")["DropDuplicates"] == 700
    assert find("aplymap")["ApplyMapping"] == 600
    assert find("s3sour")["S3CsvSource"] == 550
    assert find("qqqqzzzz") == {} and len(find("")) == 5


def test_reports_and_secrets(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<testsuite><testcase classname="tests.test_orders_csv" name="ok" time="0.0125"/>'
        '<testcase classname="tests.test_orders_csv" name="bad" time="1"><failure message="">  stack here </failure></testcase>'
        '<testcase classname="" name="lost"><error message="boom"/></testcase></testsuite>'
    )
    (tmp_path / "b.xml").write_text(f'<testsuite><testcase classname="test_pipeline" name="x" time="0"><skipped message="{"m" * 2100}"/></testcase></testsuite>')
    cases = logs.read_test_reports(spark, str(tmp_path))
    got = {r.name: (r.node, r.status, r.message, r.ms) for r in cases.collect()}
    assert got["test_orders_csv::ok"] == ("orders_csv", "pass", None, 13)
    assert got["test_orders_csv::bad"] == ("orders_csv", "fail", "stack here", 1000)
    assert got["lost"] == ("", "error", "boom", 0)
    assert got["test_pipeline::x"][0:2] == ("pipeline", "skip") and len(got["test_pipeline::x"][2]) == 2100
    totals = {r.report[-5:]: (r.passed, r.failed, r.errors, r.skipped, r.status) for r in logs.report_summary(cases).collect()}
    assert totals == {"a.xml": (1, 1, 1, 0, "failed"), "b.xml": (0, 0, 0, 1, "passed")}
    settings_ = spark.sql("SELECT map('db_PASSWORD', 'x', 'api-key', 'y', 'region', 'eu') AS m").select(logs.mask_secrets(F.col("m")).alias("m")).first().m
    assert settings_ == {"db_PASSWORD": "••••", "api-key": "••••", "region": "eu"}


def test_no_change_rule(spark):
    at = dt.datetime(2024, 1, 1)
    updates = [("r", 1, "RUNNING", None, 5), ("r", 2, "RUNNING", None, 65), ("r", 3, "SUCCEEDED", at, 70), ("r", 4, "SUCCEEDED", at, 70), ("r", 5, "SUCCEEDED", at, 71)]
    df = spark.createDataFrame(updates, "run_id string, seq bigint, state string, completed_on timestamp_ntz, execution_time int")
    assert sorted(r.seq for r in runs.changed_updates(df).collect()) == [1, 3, 5]


def test_the_index_finds_what_a_scan_finds(spark):
    """Every tier and many typos, with fewer rows scored; null and empty names, and queries shorter than their typos."""
    luck = random.Random(12)
    words = ["csv", "parquet", "join", "apply", "mapping", "select", "fields", "custom", "transform", "aggregate", "drop", "nulls", "x"]
    data = [(n, " ".join(luck.sample(words, luck.randint(1, 3))), luck.choice(words), luck.sample([*words, None], 2)) for n in range(400)]
    data += [(400, None, None, None), (401, "", "", []), (402, "C.S.V!", "Parquet-File", ["a b"])]
    df = spark.createDataFrame(data, "n int, name string, kind string, keys array<string>")
    index = NameIndex.build(df, "n", "name", "kind", "keys")
    name, kind = (F.coalesce(F.col(c), F.lit("")) for c in ("name", "kind"))
    keys = F.filter(F.coalesce("keys", F.array().cast("array<string>")), lambda k: k.isNotNull())
    for query in ("cvs", "aplymap", "agregat", "trnasfrom", "slect", "a b", "x", "zq", "jion", ""):
        want = df.select(F.col("n").alias("id"), search.score(query, name, kind, keys).alias("score")).where("score IS NOT NULL")
        assert rows(index.search(query)) == rows(want), query
    assert index.candidates("agregat").count() < 300 and index.candidates("trnasfrom").count() < 300
