import hashlib
import random

import numpy as np
from conftest import rows
from helpers_llm import con, no_docs, odd_docs, same_as_sql, small_docs  # noqa: F401

from weirworks.llm.cuckoo import CuckooFilter, filled
from weirworks.llm.line_dedup import LineIndex, dedup_lines
from weirworks.session import scratch_path


def brute(docs):
    """docs: (id, text). Text of each without the lines that a smaller id holds too."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first, last = {}, {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), i), i)
            last[key(line)] = max(last.get(key(line), i), i)
    gone = lambda i, line: len(key(line)) >= 10 and first[key(line)] < i
    return sorted((i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in docs)


def test_query(spark, con):
    same_as_sql(spark, con, "op4_line_dedup")


def test_filter_holds_its_keys_and_forgets():
    luck = np.random.default_rng(1)
    keys = luck.integers(0, 2**63, 20_000).astype(np.uint64)
    f = filled(keys)
    assert f.has(keys).all()
    others = luck.integers(0, 2**63, 200_000).astype(np.uint64)
    assert f.has(others).mean() < 0.001
    g = CuckooFilter.from_bytes(f.to_bytes())
    g.remove(keys[:1_000])
    assert g.has(keys[1_000:]).all()
    assert g.has(keys[:1_000]).mean() < 0.01
    assert not CuckooFilter.sized(0).has(keys[:10]).any()


def test_batches_and_deletions_are_as_if_made_anew(spark):
    luck = random.Random(4)
    lines = [f"line number {n} of the story" for n in range(12)] + ["short", "", "  Line NUMBER 3 of the story\t"]
    docs = [(i, "\n".join(luck.choice(lines) for _ in range(luck.randint(1, 5)))) for i in range(40)]
    frame = lambda d: spark.createDataFrame(d, "doc_id long, text string")
    index = LineIndex(spark, scratch_path(spark, "t"), expected_keys=10)
    index.insert(frame(docs[20:]))
    index.insert(frame(docs[:20]))
    assert rows(index.clean(frame(docs))) == [tuple(r) for r in sorted(brute(docs), key=repr)]
    index.delete(frame([(i, None) for i in range(0, 40, 3)]))
    left = [d for d in docs if d[0] % 3]
    assert sorted(rows(index.clean(frame(left)))) == brute(left)
    more = [(100 + i, t) for i, t in docs[:9]]
    index.insert(frame(more))
    assert sorted(rows(index.clean(frame(left + more)))) == brute(left + more)
    # Taking the new ones out again brings back what was before.
    index.delete(frame(more))
    assert sorted(rows(index.clean(frame(left)))) == brute(left)


def test_odd_rows(spark, odd_docs, no_docs):
    out = dedup_lines(odd_docs, counts=("n", "d"))
    assert out.columns == [*odd_docs.columns, "n", "d"]
    got = {(r.doc_id, r.text and hashlib.md5(r.text.encode()).hexdigest()[:6], r.n, r.d) for r in out.collect()}
    by_id = {g[0]: g for g in got}
    assert by_id[1][2:] == (1, 0) and by_id[2][1:] == ("", 1, 1) and by_id[5][2:] == (4, 1)
    assert by_id[3][1:] == (None, 1, 0)  # a null text is one empty line and stays null
    assert by_id[None][3] == 1  # rows without an id come last
    assert out.count() == 10 and dedup_lines(no_docs).count() == 0


def test_the_query_asks_the_filters(spark, small_docs, monkeypatch):  # noqa: F811
    made = []
    insert = LineIndex.insert
    monkeypatch.setattr(LineIndex, "insert", lambda self, *a, **k: made.append(self) or insert(self, *a, **k))
    dedup_lines(small_docs).count()
    index = made[0]
    found = index._answers()
    asked = found.where("made > 0")
    assert len(made) == 3 and asked.count() > 0.5 * found.count()
    # What the filters of earlier batches know is what those batches hold, but for a few in thousands.
    earlier = found.alias("a").join(found.alias("b"), "key").where("a.made > b.made").select("key", "a.made").distinct()
    known = asked.where("known").select("key", "made")
    assert earlier.count() > 0 and earlier.exceptAll(known).count() == 0
    assert known.count() <= earlier.count() + 0.01 * asked.count()


def test_shards_grow_with_the_batches(spark, monkeypatch):
    """A small first load does not bind later batches to its one shard; deletions still find every filter."""
    monkeypatch.setattr("weirworks.llm.line_dedup.KEYS_PER_SHARD", 40)
    frame = lambda d: spark.createDataFrame(d, "doc_id long, text string")
    docs = [(i, f"the line that is number {i % 150}\nand of its own {i} {i}") for i in range(300)]
    index = LineIndex(spark, scratch_path(spark, "grow"))
    for first, last in ((290, 300), (0, 120), (120, 290)):
        index.insert(frame(docs[first:last]))
    shards = {(r.made, r.shards) for r in index._filters().select("made", "shards").distinct().collect()}
    assert shards == {(0, 1), (1, 8), (2, 16)}
    assert index._answers().groupBy("shards", "shard").count().agg({"count": "max"}).first()[0] <= 80
    assert sorted(rows(index.clean(frame(docs)))) == brute(docs)
    index.delete(frame(docs[:100]))
    assert sorted(rows(index.clean(frame(docs[100:])))) == brute(docs[100:])
    index.insert(frame(docs[:50]))
    assert sorted(rows(index.clean(frame(docs[:50] + docs[100:])))) == brute(docs[:50] + docs[100:])
