import random

import numpy as np
from helpers_llm import con, no_docs, odd_docs, same_as_sql  # noqa: F401

from weirworks.llm.hashing import shingle_sets
from weirworks.llm.jaccard import components, least_matches, near_copies, one_of_each, one_row_of_each


def test_query(spark, con):  # noqa: F811
    same_as_sql(spark, con, "op3_jaccard_join")


def brute(docs, threshold=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, (t or "").lower().split()) for i, t in docs)}
    links = {i: [j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        out[i] = (min(seen), len(links[i]))
    return out


def families(luck, groups, size, length=120):
    vocabulary = [f"w{n}" for n in range(3_000)]
    docs, i = [], 0
    for _ in range(groups):
        base = [luck.choice(vocabulary) for _ in range(length)]
        for _ in range(luck.randint(1, size)):
            words = list(base)
            for _ in range(luck.randint(0, 4)):
                words[luck.randrange(length)] = luck.choice(vocabulary)
            docs.append((i, " ".join(words)))
            i += 1
    return docs


def test_families_in_blocks_against_brute_force(spark):
    docs = families(random.Random(8), 12, 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_copies(frame, block=16).collect()}
    assert got == brute(docs)


def test_shingles_do_not_depend_on_the_batch():
    luck = random.Random(1)
    texts = [" ".join(luck.choice(["a", "bé", "C3", "..", "x-y"]) for _ in range(luck.randint(0, 30))) for _ in range(200)]
    together = list(shingle_sets([*texts, "z " * 800_000, None]))
    for n, t in enumerate(texts):
        assert np.array_equal(next(shingle_sets([t])), together[n])
    assert len(together[-1]) == 0 and len(together[-2]) == 1


def test_pruning_keeps_what_may_be_similar():
    least = least_matches(0.8, 1e-6)
    luck = np.random.default_rng(2)
    same = (luck.random((20_000, 64)) < 0.8).cumsum(axis=1)
    lost = np.zeros(20_000, bool)
    for n, m in least.items():
        lost |= same[:, n - 1] < m
    assert lost.mean() < 0.001 and least[64] > 30


def test_components_of_a_chain(spark):
    edges = [(i + 1, i) for i in range(100)] + [(500, 700), (700, 900)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(101)} | {500: 500, 700: 500, 900: 500}


def test_odd_rows(odd_docs, no_docs):  # noqa: F811
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_copies(odd_docs).collect()}
    # Rows that share an id are documents of the same id; texts without words are like no other; no id, no row.
    assert got[1] == (1, 3) and got[2] == (1, 3) and got[5] == (1, 3) and got[3] == (3, 0) and got[4] == (4, 0) and None not in got
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 3, 4, 6, 7, 8]
    assert near_copies(no_docs).count() == 0


def test_rows_without_an_id_or_with_a_shared_one(odd_docs):  # noqa: F811
    got = near_copies(odd_docs, every_row=True).collect()
    assert len(got) == odd_docs.count()
    assert [(r.class_id, r.n_links) for r in got if r.doc_id in (None, 1)] == [(1, 4)] * 3
    kept = one_row_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 8]


def test_every_class_keeps_one_row(spark):
    docs = families(random.Random(9), 10, 6)
    classes = {c for c, _ in brute(docs).values()}
    # Ids above 2**53 would not survive as floats; some ids are null, and all rows of a family may share one.
    big = 2**60 + 1
    odd = [(None if i % 3 == 0 else big + i % 4, t) for i, t in docs] + [(None, "")] * 3 + [(7, None)] * 2
    frame = spark.createDataFrame(odd, "doc_id long, text string").repartition(3)
    kept = one_row_of_each(frame).collect()
    assert len(kept) == len(classes) + 5
    for c in classes:
        family = [(odd[n][0], odd[n][1]) for n, (k, _) in brute(docs).items() if k == c]
        (one,) = [r for r in kept if r.text in {t for _, t in family}]
        assert one.doc_id == min((i for i, _ in family if i is not None), default=None)
    links = near_copies(frame, every_row=True)
    assert links.count() == len(odd) and links.where("doc_id IS NULL").count() == sum(i is None for i, _ in odd)
