"""Ids near the ends of their type stay what they are beside nulls, in every operator and stage that passes rows through Python."""

import corpus_pipeline
from helpers_llm import PROSE, SMALL

from weirworks.llm import line_dedup, quality, repeats, toxicity
from weirworks.llm.bpe import decode, encode
from weirworks.llm.queries import tokenizer_path

IDS = [2**60 + 1, 2**60 + 3, None, 2**63 - 1, -(2**63), 7]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark):
    rows = [(i, f"{PROSE} number {n}", "en", "a", None if n % 2 else 2**60 + 2 * n + 1) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def pairs(df):
    return sorted(((r.doc_id, r.n_chars) for r in df.collect()), key=repr)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=repr)


def test_tokens(spark):
    df = docs(spark)
    coded = encode(df, tokenizer_path(), decoded="back")
    assert pairs(coded) == pairs(df)
    assert pairs(decode(coded, tokenizer_path())) == pairs(df)
    assert ids(corpus_pipeline.to_tokens(spark, df, SMALL)) == ids(df)


def test_toxicity(spark):
    df = docs(spark)
    model = toxicity.Model({}, curve=(-3.0, 0.0, 0.0))
    assert ids(toxicity.with_scores(df, model)) == ids(df)
    assert pairs(toxicity.clean_documents(df, model)) == pairs(df)
    whole = spark.read.parquet(f"{SMALL}/documents.parquet").select(df.columns).unionByName(df.where("doc_id IS NULL OR doc_id <> 7")).coalesce(1)
    assert set(pairs(corpus_pipeline.drop_toxic(spark, whole, SMALL))) >= {p for p in pairs(df) if p[0] != 7}


def test_quality(spark):
    labels = spark.createDataFrame([(i, 1) for i in IDS if i], "doc_id long, quality int")
    assert ids(quality.resample(docs(spark), labels, share=1.0)) == ids(docs(spark))


def test_lines_and_repeats(spark):
    df = docs(spark)
    assert pairs(line_dedup.dedup_lines(df)) == pairs(df)
    assert ids(repeats.without_repeats(df)) == ids(df)
