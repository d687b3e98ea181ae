import datetime as dt
import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from weirworks.operators import aggregate as agg
from weirworks.operators import audit, joins
from weirworks.operators.ordered import in_pieces, numbered, top_per_key, with_previous


def test_same_names_get_a_suffix_and_keys_must_pair(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, V string")
    out = joins.join(a, b, ["k"], how="outer")
    assert out.columns == ["k", "v", "k_right", "V_right"]
    assert rows(out) == [(1, "x", 1, "p"), (2, "y", None, None), (None, None, 3, "q")]
    assert rows(joins.join(a, a, ["k"])) == [(1, "x", 1, "x"), (2, "y", 2, "y")]
    assert joins.join(a, b, ["k"], how="leftanti").columns == ["k", "v"]
    with pytest.raises(ValueError):
        joins.join(a, b, ["k", "v"], ["k"])
    with pytest.raises(ValueError):
        joins.join(a, b, ["k"], how="sideways")


def test_merge_takes_the_latest_change(spark):
    base = spark.createDataFrame([(1, "old"), (2, "keep")], "k int, v string")
    changes = spark.createDataFrame([(1, "first", 1), (1, "second", 2), (3, "new", 1)], "k int, v string, at int")
    assert rows(joins.merge(base, changes, ["k"], [F.desc("at")]).select("k", "v")) == [(1, "second"), (2, "keep"), (3, "new")]


@pytest.fixture(scope="module")
def lopsided(spark):
    """A third of the rows on one key, and some on no key."""
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 500).cast("int").alias("k")).cache()


def test_unique_join_spreads_the_hot_key_and_keeps_every_row(spark, lopsided):
    side = spark.range(400).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    got = joins.join_unique(lopsided, side, ["k"])
    want = lopsided.join(side, "k", "left").select("id", "k", "v")
    assert rows(got.select("id", "k", "v")) == rows(want)
    # NULL meets NULL, and a hot key the other side does not have stays without a value.
    nulls = spark.createDataFrame([(None, 1)], "k int, v int")
    assert joins.join_unique(lopsided, nulls, ["k"]).where("v = 1").count() == lopsided.where("k IS NULL").count()


def largest_share(df):
    """Rows of the fullest partition over the rows of an average one."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) * 16 / sum(sizes)


@pytest.fixture
def sixteen(spark):
    """Sixteen partitions that nothing joins together and no side small enough to broadcast."""
    wanted = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("copies", [False, True])
def test_hot_key_is_dealt_out(spark, sixteen, copies):
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k")
    df = spark.range(0, 160_000, 1, 16).select(key, F.lit(1).alias("v") if copies else F.col("id").alias("v"))
    side = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert largest_share(df.join(side, "k", "left")) > 4
    assert largest_share(joins.join_unique(df, side, ["k"])) < 2
    assert largest_share(joins.salted_join(df, side, ["k"], 64, audit.hot_keys(df, ["k"], 0.1))) < 2


@pytest.mark.parametrize("how", ["inner", "left", "leftsemi", "leftanti"])
def test_salted_join_equals_the_plain_one(spark, lopsided, how):
    side = spark.range(400).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v")).unionAll(spark.createDataFrame([(7, -1)], "k int, v bigint"))
    hot = audit.hot_keys(lopsided, ["k"], share=0.2)
    assert [r.k for r in hot.collect()] == [7]
    got = joins.salted_join(lopsided, side, ["k"], 8, hot, how)
    want = lopsided.join(side, "k", how)
    assert rows(got.select(*want.columns)) == rows(want)


def test_as_of_join_against_brute_force(spark):
    day = lambda n, h=0: dt.datetime(2024, 1, 1, h) + dt.timedelta(days=n)
    left = [(k, day(n, 5)) for k in (1, 2, 3) for n in (0, 3, 3, 9)]
    right = [(k, day(n, h), n * 10 + h) for k in (1, 2) for n, h in ((0, 1), (2, 3), (2, 4), (3, 1), (8, 0))]
    l_df, r_df = spark.createDataFrame(left, "k int, t timestamp_ntz"), spark.createDataFrame(right, "k int, at timestamp_ntz, v int")
    got = rows(joins.latest_before(l_df, r_df, ["k"], "t", "at", ["v"]))
    want = []
    for k, t in left:
        earlier = [(at, v) for rk, at, v in right if rk == k and at.date() < t.date()]
        want.append((k, t, *(max(earlier) if earlier else (None, None))))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("or_equal", [True, False])
def test_as_of_any_instant_against_brute_force(spark, or_equal):
    """A hot key over several ranges, several rows an instant, null keys and times, names that clash."""
    luck = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    time = lambda: None if luck.random() < 0.02 else t0 + dt.timedelta(minutes=luck.randrange(400))
    key = lambda: luck.choice([1, 1, 1, 1, 2, 3, None])
    left = [(key(), time(), n) for n in range(300)]
    right = [(key(), time(), luck.choice([None, n % 7])) for n in range(200)]
    l_df, r_df = spark.createDataFrame(left, "k int, t timestamp_ntz, `_row` int"), spark.createDataFrame(right, "k int, `at.x` timestamp_ntz, v int")
    got = rows(joins.latest_at(l_df, r_df, ["k"], "t", "at.x", ["v"], or_equal=or_equal, pieces=7))
    want = []
    for k, t, n in left:
        held = [(at, v is not None, v) for rk, at, v in right if None not in (k, t, at) and rk == k and (at < t or or_equal and at == t)]
        best = max(held) if held else (None, None, None)
        want.append((k, t, n, best[0], best[2]))
    assert got == sorted(want, key=repr)
    assert joins.latest_at(l_df.limit(0), r_df, ["k"], "t", "at.x", ["v"]).count() == 0
    assert joins.latest_at(l_df, r_df.limit(0), ["k"], "t", "at.x", ["v"]).where("v IS NOT NULL").count() == 0


def test_previous_row_against_brute_force(spark, lopsided):
    data = lopsided.withColumn("v", F.when(F.col("id") % 5 > 0, F.col("id") * 2))
    got = {r.id: (r.prev_v, r.has_prev) for r in with_previous(data, ["k"], ["id"], ["v"], pieces=6).collect()}
    last, want = {}, {}
    for r in sorted(data.collect(), key=lambda r: r.id):
        want[r.id] = (last.get(r.k), r.k in last)
        last[r.k] = r.v
    assert got == want


def test_numbering_is_gapless_and_ordered(spark, lopsided):
    got = sorted((r.no, r.id) for r in numbered(lopsided, ["k", "id"], "no").collect())
    assert [n for n, _ in got] == list(range(1, 3001))
    order = sorted(lopsided.collect(), key=lambda r: (r.k is not None, r.k or 0, r.id))
    assert [i for _, i in got] == [r.id for r in order]


def test_ordered_work_shuffles_the_rows_once(spark):
    """One exchange moves rows, by piece; the others carry one row per piece. A key with all rows is cut into pieces."""
    hot = spark.range(4_000).select(F.lit(1).alias("k"), ((F.col("id") * 7_919) % 4_001).alias("v"), F.lit("text").alias("t"))
    for df in (numbered(hot, ["k", "v"], "no", pieces=8), with_previous(hot, ["k"], ["v"], ["t"], pieces=8)):
        text = plan(df)
        moved = [line for line in text.splitlines() if "Exchange" in line and "Broadcast" not in line]
        assert sum("shufflepartitionidpassthrough" in line for line in moved) == 1
        assert all("shufflepartitionidpassthrough" in line or "_piece" in line or "SinglePartition" in line for line in moved)
        assert "MapIn" not in text
    sizes = [r["count"] for r in in_pieces(hot, ["k", "v"], 8)[0].groupBy("_piece").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4_000 / 8


def test_ordered_work_on_odd_rows(spark):
    """Nulls in keys and order come first, names with dots, empty tables, one piece, more pieces than rows."""
    data = [(None, 1, "a"), (None, None, None), (2, 5, "b"), (2, 4, None), (2, None, "c")]
    df = spark.createDataFrame(data, "`k.x` int, o int, v string")
    want = [(None, None, None, None, False), (None, 1, "a", None, True), (2, None, "c", None, False), (2, 4, None, "c", True), (2, 5, "b", None, True)]
    for pieces in (1, 3, 50):
        assert rows(with_previous(df, ["k.x"], ["o"], ["v"], pieces=pieces)) == sorted(want, key=repr)
        assert [r.o for r in numbered(df, ["k.x", "o"], "no", pieces=pieces).orderBy("no").collect()] == [None, 1, None, 4, 5]
    assert numbered(df.limit(0), ["o"]).count() == 0 == with_previous(df.limit(0), ["k.x"], ["o"], ["v"]).count()


def test_top_per_key_limits_before_the_shuffle(spark, lopsided):
    top = top_per_key(lopsided, ["k"], [F.desc("id")], 2)
    text = plan(top)
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert sorted(r.id for r in top.where("k = 7").collect()) == [2994, 2997]


def test_aggregate_names_and_errors(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", None)], "g string, v int")
    out = agg.aggregate(df, ["g"], [("v", "sum"), ("v", "count"), ("v", "countDistinct")])
    assert out.columns == ["g", "v_sum", "v_count", "v_countDistinct"]
    assert rows(out) == [("a", 4, 2, 2), ("b", None, 0, 0)]
    assert rows(agg.aggregate(df)) == [(3,)]
    with pytest.raises(ValueError):
        agg.aggregate(df, ["g"], [("v", "median")])


def test_diff_with_nulls(spark):
    old = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, None), (4, "z")], "k int, v string")
    assert rows(agg.snapshot_diff(old, new, ["k"], ["v"])) == [(2, "modified"), (3, "removed"), (4, "added")]
    assert rows(agg.snapshot_diff(old, new, ["k"])) == [(3, "removed"), (4, "added")]


def test_health_counts_keys_without_joining_rows(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (3,)], "j int")
    assert audit.join_health(a, b, ["k"], ["j"]).first().asDict() == {
        "left_rows": 4, "right_rows": 3, "left_null_keys": 1, "left_matched": 2, "left_unmatched": 2, "right_repeated_keys": 1, "joined_rows": 4,
    }
    empty = audit.join_health(a.limit(0), b, ["k"], ["j"]).first()
    assert (empty.left_rows, empty.joined_rows) == (0, 0)


def test_lookup_is_the_same_for_any_size(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "id int, k bigint")
    answers = []
    for more in (0, 100_000):
        dim = spark.createDataFrame([(0, "a"), (1, "b"), (None, "n")], "k bigint, v string").union(spark.range(10, 10 + more).select("id", F.lit("x")))
        answers.append(joins.lookup(df, dim, ["k"], ["v"]))
    assert [a.columns for a in answers] == [["id", "k", "v"]] * 2
    assert [rows(a) for a in answers] == [[(1, 0, "a"), (2, None, None)]] * 2


def test_hot_null_keys_are_spread(spark):
    left = spark.range(3_000).select("id", F.lit(None).cast("int").alias("k"))
    right = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = joins.salted_join(left.repartition(4), right, ["k"], 4, left.select("k").limit(1), "left")
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in sizes) == 3_000 and out.where("v IS NOT NULL").count() == 0


def test_lookup_with_repeated_keys(spark):
    df = spark.range(6).select((F.col("id") % 3).alias("k"))
    dim = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k bigint, name string")
    assert rows(joins.lookup(df, dim, ["k"], ["name"], [F.desc("name")])) == [(0, "b"), (0, "b"), (1, "c"), (1, "c"), (2, None), (2, None)]
