import datetime as dt
import json
import tracemalloc

import numpy as np
import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from weirworks.functions import signatures as sig
from weirworks.plans import streams
from weirworks.plans.registry import Data
from weirworks.streaming import events, flow, followed, state, windows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def update(job, run, state_, start, seq, done=None, took=None):
    at = lambda h: None if h is None else T0 + dt.timedelta(hours=h)
    return (job, run, state_, at(start), at(done), took, seq)


def follow(spark, home, *batches):
    """The rows of the change stream after each batch came as a file."""
    src, out, mark = (str(home / n) for n in ("src", "out", "mark"))
    for batch in batches:
        spark.createDataFrame(list(batch), state.SCHEMA).coalesce(1).write.mode("append").parquet(src)
        changes = state.run_changes(flow.source(spark, "parquet", schema=state.SCHEMA, path=src, files_per_batch=1))
        flow.load_new(changes, out, mark)
    return spark.read.schema(changes.schema).parquet(out)


def test_older_runs_of_another_id_are_ignored(spark, tmp_path):
    told = follow(
        spark, tmp_path,
        [update("j", "r2", "RUNNING", 5, 1)],
        [update("j", "r1", "FAILED", 3, 2)],
        [update("j", "r2", "SUCCEEDED", 4, 3, done=6, took=60)],
        [update("j", "r2", "SUCCEEDED", 4, 4, done=6, took=60)],
        [update("j", "r3", "RUNNING", 4, 5), update("k", "q", "RUNNING", 1, 6)],
    )
    # r2 may move back in time since it is the run held; r3 then starts no earlier than it and takes over.
    assert rows(told.select("job", "change", "run_id", "state", "seq", "told")) == [
        ("j", 1, "r2", "RUNNING", 1, True), ("j", 2, "r2", "SUCCEEDED", 3, True), ("j", 3, "r3", "RUNNING", 5, True), ("k", 1, "q", "RUNNING", 6, True),
    ]
    assert rows(state.current(told).select("job", "run_id")) == [("j", "r3"), ("k", "q")]


def test_every_change_of_a_batch_is_told_in_order(spark, tmp_path):
    """r1 fails and r2 starts in one batch, whose rows come in any order; then r2 ends beside a late word of r1."""
    told = follow(
        spark, tmp_path,
        [update("j", "r2", "RUNNING", 3, 3), update("j", "r1", "FAILED", 1, 2, done=2), update("j", "r1", "RUNNING", 1, 1)],
        [update("j", "r1", "STOPPED", 1, 4, done=2), update("j", "r2", "SUCCEEDED", 3, 5, done=4, took=7), update("j", "r2", "SUCCEEDED", 3, 6, done=4, took=8)],
    )
    assert [(r.change, r.run_id, r.state, r.execution_time) for r in told.orderBy("step").collect()] == [
        (1, "r1", "RUNNING", None), (2, "r1", "FAILED", None), (3, "r2", "RUNNING", None), (4, "r2", "SUCCEEDED", 7), (5, "r2", "SUCCEEDED", 8),
    ]


def test_running_time_alone_is_no_change_but_is_kept(spark, tmp_path):
    batches = [[update("j", "a", "RUNNING", 1, 1, took=5)], [update("j", "a", "RUNNING", 1, 2, took=65)], [update("j", "a", "FAILED", 1, 3, done=2, took=70)]]
    told = follow(spark, tmp_path, *batches[:2])
    assert [(r.execution_time, r.told) for r in told.orderBy("step").collect()] == [(5, True), (65, False)]
    assert state.current(told).first().execution_time == 65
    told = follow(spark, tmp_path, *batches[2:])
    assert [r.state for r in told.where("told").orderBy("step").collect()] == ["RUNNING", "FAILED"]


def test_odd_updates(spark, tmp_path):
    """Nulls: without job, run or seq an update is ignored; without a start a run has just started; without a state it has ended."""
    told = follow(
        spark, tmp_path,
        [(None, "r", "RUNNING", T0, None, 1, 1), ("j", None, "RUNNING", T0, None, 1, 1), ("j", "r", "RUNNING", T0, None, 1, None)],
        [update("j", "a", None, None, 1), update("j", "b", "RUNNING", 9, 2), update("j", "a", None, None, 3, took=2**31 - 1)],
    )
    got = [(r.run_id, r.state, r.started_on, r.completed_on, r.execution_time) for r in told.orderBy("step").collect()]
    assert got == [("a", None, None, None, None), ("a", None, None, None, 2**31 - 1)]


def test_messages(spark):
    call = lambda name, **d: json.dumps({"detail-type": "AWS API Call via CloudTrail", "detail": {"eventName": name, **d}})
    messages = [
        json.dumps({"detail-type": "Glue Job State Change", "detail": {"jobName": "orders", "state": "FAILED", "jobRunId": "jr_1"}}),
        json.dumps({"detail-type": "Glue Job State Change", "detail": {"jobName": "orders"}}),
        call("UpdateJob", requestParameters={"name": "orders"}), call("DeleteJob", requestParameters={"jobName": "old"}),
        call("StartJobRun", requestParameters={"jobName": "orders"}, responseElements={"jobRunId": "jr_2"}),
        call("StartJobRun", requestParameters={"jobName": "orders"}), call("BatchStopJobRun", requestParameters={"jobName": "orders", "jobRunIds": ["jr_3", "jr_4"]}),
        call("CreateJob", requestParameters={}), call("GetJob", requestParameters={"jobName": "orders"}), json.dumps({"detail-type": "Other"}), "{not json", "",
    ]
    df = spark.createDataFrame([(m,) for m in messages], "value string")
    assert rows(events.decode(df)) == sorted([
        ("run", "orders", "jr_1"), ("job", "orders", None), ("removed", "old", None), ("run", "orders", "jr_2"), ("run", "orders", "jr_3"), ("run", "orders", "jr_4"),
    ], key=repr)
    assert [r.value for r in events.broken(df).collect()] == ["{not json", ""]


def test_streams_take_up_where_they_stopped(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for part in (range(0, 3), range(3, 5)):
        spark.createDataFrame([(i,) for i in part], "id bigint").write.mode("append").json(src)
        flow.load_new(flow.source(spark, "json", schema="id bigint", path=src, files_per_batch=1), out, mark)
        flow.load_new(flow.source(spark, "json", schema="id bigint", path=src), out, mark)
    assert rows(spark.read.parquet(out)) == [(i,) for i in range(5)]


def test_session_table_equals_the_streaming_window(spark):
    gap, minutes = 600, [0, 1, 9, 19, 40, 41, 100, 109, 120, 121, 135]
    data = [(u, T0 + dt.timedelta(minutes=m, seconds=7 * u)) for u in range(3) for m in minutes[u:]]
    df = spark.createDataFrame(data, "u int, ts timestamp")
    want = df.groupBy("u", F.session_window("ts", "10 minutes").alias("s")).agg(F.count(F.lit(1)).alias("n")).select("u", "s.start", "s.end", "n")
    assert rows(windows.session_table(df, ["u"], "ts", gap)) == rows(want)


def test_session_edge_is_the_same_as_in_the_window(spark):
    """Two rows exactly one gap apart."""
    df = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(minutes=10)), (1, T0 + dt.timedelta(minutes=25))], "u int, ts timestamp")
    want = df.groupBy("u", F.session_window("ts", "10 minutes").alias("s")).agg(F.count(F.lit(1)).alias("n")).select("u", "s.start", "s.end", "n")
    assert rows(windows.session_table(df, ["u"], "ts", 600)) == rows(want)


def test_exclusions_hold_for_the_whole_run(spark, tmp_path):
    """A later batch excludes what an earlier line met; silence ends a run, by a timer or by its next line."""
    rules = [sig.Signature("exit", "exit code 1", 0.5, "", "", unless="no space"), sig.Signature("slow", "throttl", 0.5, "", "")]
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    batches = [
        [("a", at(0), 1, "Exit code 1"), ("a", at(1), 2, "THROTTLED"), ("b", at(0), 3, "exit code 1"), (None, at(0), 4, "exit code 1"), ("c", at(2), 5, None)],
        [("a", at(5), 6, "No space left"), ("a", at(4), 7, "throttled again"), ("b", at(100), 8, "exit code 1"), ("b", at(101), 9, "no space")],
        [("z", at(500), 10, "quiet")],
    ]
    schema = "run_id string, ts timestamp, event_id bigint, line string"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        found = followed.run_signatures(flow.source(spark, "parquet", schema=schema, path=src, files_per_batch=1), 30 * 60, "10 minutes", rules=rules)
        flow.load_new(found, out, mark)
    got = spark.read.schema(found.schema).parquet(out)
    assert rows(got.select("run_id", "id", "event_id")) == [("a", "slow", 2), ("b", "exit", 3)]
    assert {(r.run_id, r.opened) for r in got.select("run_id", F.unix_seconds("opened").alias("opened")).collect()} == {(r, int(T0.timestamp())) for r in "ab"}


class Value:
    """A value state outside Spark."""

    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_updates_of_a_job_are_sorted_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(state, "SORTED", 20_000, raising=False)
    n = 200_000

    def chunks():
        for at in range(n - 10_000, -1, -10_000):
            seq = np.arange(at, at + 10_000)[::-1]
            yield pd.DataFrame({"run_id": [f"jr_{s // 2}" for s in seq], "state": [("RUNNING", "FAILED")[s % 2] for s in seq],
                                "started": seq // 2, "completed": np.where(seq % 2, seq, state.NONE), "took": seq % 2, "seq": seq})

    changes = state._Changes()
    changes.held = Value()
    tracemalloc.start()
    told = 0
    for part in changes.handleInputRows(("j",), chunks(), None):
        assert part["seq"].tolist() == list(range(told, told + len(part))) and part["change"].tolist() == list(range(told + 1, told + len(part) + 1))
        told += len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told == n and changes.held.get() == (f"jr_{n // 2 - 1}", "FAILED", n // 2 - 1, n - 1, 1, n, n)
    assert peak < 60 * 10**6


def test_updates_of_one_seq_stay_as_they_came(monkeypatch):
    monkeypatch.setattr(state, "SORTED", 3, raising=False)
    seqs = [[5, 1], [1, 3], [5, 1, 2], [1]]
    made, number = [], 0
    for part in seqs:
        made.append(pd.DataFrame([(f"r{number + i}", "", 0, 0, 0, s) for i, s in enumerate(part)], columns=list(state.FIELDS)))
        number += len(part)
    want = sorted((t for part in made for t in part.itertuples(index=False, name=None)), key=lambda t: t[5])
    assert list(state.in_order(iter(made))) == want


def files_of(monkeypatch, tmp_path, name, run):
    """Files that ``run`` writes to its scratch folder of this name, and its rows."""
    made = []
    monkeypatch.setattr(streams, "scratch_path", lambda spark, n: made.append(n) or str(tmp_path / n))
    got = rows(run())
    return len(list((tmp_path / name).glob("*.parquet"))), got


def test_lines_to_follow_lie_in_several_files(spark, small, monkeypatch, tmp_path):
    """No single task reads all lines and tries all patterns on them."""
    want = rows(streams.stream_log_follow_runs(Data(spark, small)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n, got = files_of(monkeypatch, tmp_path, "followed-lines", lambda: streams.stream_log_follow_runs(Data(spark, small)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n > 1 and got == want


def test_files_of_updates_grow_in_number_not_in_size(spark, small, monkeypatch, tmp_path):
    want = rows(streams.stream_latest_run(Data(spark, small)))
    monkeypatch.setattr(streams, "FILE_UPDATES", 500, raising=False)
    n, got = files_of(monkeypatch, tmp_path, "updates", lambda: streams.stream_latest_run(Data(spark, small)))
    assert n >= 10 and got == want
