"""Every stage of the pipeline next to a plain version of it, on what the stage before kept."""

import pytest
from helpers_llm import SMALL, con, no_docs, odd_docs, small_docs  # noqa: F401
from test_jaccard import brute as near
from test_line_dedup import brute as lines

import __spark_entry__
import corpus_pipeline
from weirworks.llm import bpe, queries
from weirworks.session import cut_lineage


@pytest.fixture(scope="module")
def kept(spark, small_docs):  # noqa: F811
    out, docs = [small_docs], small_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SMALL))
        out.append(docs)
    return out


def test_stages(spark, kept):
    docs, clean, short, single, mixed, tokens = kept
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding",
    ]
    assert all(d.columns == docs.columns for d in kept[:-1])
    text = lambda d: {r.doc_id: r.text for r in d.collect()}
    all_, after = text(docs), [text(d) for d in kept[1:-1]]
    model = queries.toxicity_model(spark, docs, SMALL)
    assert set(after[0]) == {i for i, t in all_.items() if model.score(t) < 0.3}
    assert sorted(after[1].items()) == lines(sorted(after[0].items()))
    classes = near([(i, "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t)) for i, t in after[1].items()])
    assert set(after[2]) == {i for i, (c, _) in classes.items() if c == i}
    words = {i: len(t.split()) for i, t in after[2].items()}
    taken = [r.doc_id for r in mixed.collect()]
    assert set(taken) <= set(after[2]) and max(map(taken.count, set(taken))) <= 2
    assert 1.2 * sum(words.values()) < sum(words[i] for i in taken) <= 1.55 * sum(words.values())
    coder = bpe.BytePairs(bpe.read_vocabulary(queries.tokenizer_path()))
    rows = tokens.collect()
    assert sorted(r.doc_id for r in rows) == sorted(taken)
    assert all(list(r.ids) == coder.encode(after[3][r.doc_id]) and r.decoded == coder.decode(list(r.ids)) for r in rows)


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in names if q.startswith("op")}
    assert names["pipeline"](spark, SMALL).count() > 0


def test_odd_rows(spark, odd_docs):  # noqa: F811
    docs = odd_docs.selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = cut_lineage(stage(spark, some, SMALL))
        assert some.columns == ["doc_id", "source", "ids", "decoded"]


def test_null_and_shared_ids_reach_the_end(spark):
    word = lambda i: " ".join(f"w{(i + 1) * (k + 3) % 997}x{i}" for k in range(12))
    docs = [(None if i % 2 else 5, word(i), "en", f"s{i % 2}", 0) for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    single = cut_lineage(corpus_pipeline.drop_near_copies(spark, docs, SMALL))
    assert single.count() == 40 and single.where("doc_id IS NULL").count() == 20
    texts = [r.text for r in corpus_pipeline.mix_sources(spark, single, SMALL).collect()]
    assert abs(len(texts) - 60) <= 2 and max(map(texts.count, texts)) <= 2
