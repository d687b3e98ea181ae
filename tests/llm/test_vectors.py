import math

import numpy as np
import pytest
from helpers_llm import con, no_docs, odd_docs, same_as_sql, small_docs  # noqa: F401
from pyspark.sql import functions as F

from weirworks.llm.forest import neighbours
from weirworks.llm.threshold import SortedLists, top_scores


def test_query(spark, con):
    same_as_sql(spark, con, "op10_top_scores")


@pytest.fixture(scope="module")
def vectors(spark):
    luck = np.random.default_rng(3)
    middle = luck.standard_normal((30, 24)) * 3
    data = middle[luck.integers(0, 30, 6_000)] + luck.standard_normal((6_000, 24))
    data[:1_500] = data[0]  # one common vector
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>"), data


def brute(data, every, k):
    out = {}
    for q in range(0, len(data), every):
        s = data @ data[q]
        ids = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:k]
        out[q] = [(int(i), s[i]) for i in ids]
    return out


def test_forest_finds_nine_of_ten(vectors):
    df, data = vectors
    got = {}
    for r in neighbours(df, F.col("vec_id") % 60 == 0, least=200, share=0.5, block_rows=1_000, chunk_rows=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(data, 60, 20)
    assert set(got) == set(want)
    right = [len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want if q >= 1_500]
    assert np.mean(right) >= 0.9
    for q in got:
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
        assert all(math.isclose(s, float(data[v] @ data[q]), rel_tol=1e-12) for _, v, s in got[q])


def test_threshold_is_exact_with_ties(vectors):
    df, data = vectors
    whole = np.floor(256 * data)
    want = brute(whole, 100, 5)
    got = {}
    for r in top_scores(df, F.col("vec_id") % 100 == 0, block_rows=700, chunk_rows=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: [(v, int(s)) for v, s in rows] for q, rows in want.items()}


def test_threshold_stops_early():
    luck = np.random.default_rng(5)
    data = np.floor(luck.standard_normal((4_000, 2)) * 100)
    lists = SortedLists(data)
    read = []
    lists.order = type("Watched", (np.ndarray,), {"__getitem__": lambda s, k: (read.append(k), np.ndarray.__getitem__(s, k))[1]})(lists.order.shape, lists.order.dtype, lists.order.tobytes())
    ids, scores = lists.top(np.array([3.0, 1.0]), np.arange(4_000), -1, 5)
    assert sorted(scores.tolist()) == sorted(np.sort(data @ [3, 1])[-5:].tolist())
    assert len(read) <= 4 * (len(lists.levels()) - 2)  # four accesses a level; the last levels are never read


@pytest.mark.parametrize("op", [neighbours, top_scores])
def test_odd_rows(spark, op):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x"), (1, None, "x"), (2, [1.0, None], "x"), (3, [nan, 1.0], None), (4, [inf, 1.0], "x"), (5, [], "x")]
    rows += [(6, [2.0, 1.0], "x"), (7, [0.0, 0.0], "x"), (8, [1.0, 2.0, 3.0], "x"), (None, [1.0, 1.0], "x"), (6, [2.0, 1.0], "x"), (9, [-1.0, -1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    got = [(r.query_id, r.vec_id) for r in op(df, F.col("vec_id") % 2 == 0, k=3).orderBy("query_id", "rank").collect()]
    # Without nulls, non-finite parts or ids; only vectors of one length meet; a zero vector scores but is no neighbour.
    assert got[:3] == ([(0, 6), (0, 6), (0, 9)] if op is neighbours else [(0, 6), (0, 6), (0, 7)])
    assert all(q != v for q, v in got) and not {8} & {q for q, _ in got}
    assert op(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0
