import random

from helpers_llm import no_docs, odd_docs  # noqa: F401

from weirworks.llm.quality import log_ratios, resample, top_rows, weighed


def test_good_texts_are_drawn_and_junk_is_not(spark):
    luck = random.Random(5)
    words = ["river", "stone", "light", "morning", "letter", "window", "green", "slowly", "carry", "found"]
    prose = lambda: " ".join(luck.choice(words) for _ in range(60)).capitalize() + "."
    junk = lambda: " ".join(luck.choice(words).upper() + "!!" for _ in range(60))
    docs = [(i, junk() if i % 5 == 0 else prose()) for i in range(500)]
    labels = [(i, int(i % 5 > 0)) for i in range(0, 500, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    taken = {r.doc_id for r in resample(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(taken) == 400 and len([i for i in taken if i % 5 == 0]) <= 4


def test_weights_are_sums_over_the_whole_text(spark):
    import numpy as np

    from weirworks.llm.quality import BUCKETS, _grams

    ratios = np.linspace(-1, 1, BUCKETS)
    text = "One two  two THREE!! \n four " * 5_000
    got = weighed(spark.createDataFrame([(1, text), (2, "a"), (3, None)], "doc_id long, text string"), ratios).collect()
    want = ratios[_grams([text.encode()])[0]].sum()
    assert abs(got[0].log_weight - want) < 1e-6 and got[2].log_weight == 0


def test_top_rows_without_a_sort(spark):
    luck = random.Random(6)
    rows = [(i, luck.choice([1.0, 2.0, luck.gauss(0, 1), luck.gauss(0, 1) * 1e9])) for i in range(5_000)]
    df = spark.createDataFrame(rows, "doc_id long, draw double").cache()
    for k in (0, 1, 777, 2_500, 4_999, 5_000, 9_000):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        got = top_rows(df, k, "draw", "doc_id", bins=16, sortable=50).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_odd_rows(spark, odd_docs, no_docs):  # noqa: F811
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert resample(odd_docs, labels).count() == 5  # half the labels are good
    assert resample(odd_docs, labels, share=1.0).count() == 10
    assert resample(no_docs, labels).count() == 0 and resample(odd_docs, labels.limit(0)).count() == 10
    assert not log_ratios(odd_docs, labels.limit(0)).any()
