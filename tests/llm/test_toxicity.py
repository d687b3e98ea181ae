import random

import pytest
from helpers_llm import no_docs, odd_docs  # noqa: F401

from weirworks.llm import toxicity
from weirworks.llm.queries import QUERIES


def test_folding_undoes_disguises():
    assert toxicity.fold("You 1D10T!") == toxicity.fold("you idiot.") == " you idiot "
    assert toxicity.fold("ѕсum") == toxicity.fold("$cum") == " scum "
    assert toxicity.fold("mör​on") == " moron " and toxicity.fold("") == "  " and toxicity.fold("l0ser") == toxicity.fold("1oser")


def test_exceptions_and_length():
    model = toxicity.Model({" ciown ": 5.0, " trash": 4.0}, ("ciown fish",))
    assert model.matches(toxicity.fold("a clown fish")) == {} and len(model.matches(toxicity.fold("a clown, fishy"))) == 1
    assert len(model.matches(toxicity.fold("trashy"))) == 1 and model.matches(toxicity.fold("trash")) == {}
    assert model.score("clown") > model.score("clown " + "word " * 500) > model.score("word")


def labelled(n=600):
    luck = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("alo", "eri", "onu", "ist")]
    docs, labels = [], []
    for i in range(n):
        text = [luck.choice(words) for _ in range(luck.randint(20, 60))]
        toxic = int(luck.random() < 0.25)
        for _ in range(3 * toxic):
            text.insert(luck.randrange(len(text)), luck.choice(["vilkor", "vi1kor", "zumbled", "zumbler"]))
        if luck.random() < 0.3:
            text.insert(0, "zumblex park")
        docs.append((i, " ".join(text), "x"))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = labelled()
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    return frame, labels, toxicity.learn(frame, marks.where("doc_id % 4 <> 2"))


def test_held_out_accuracy(learned):
    frame, labels, model = learned
    scores = {r.doc_id: r.score for r in toxicity.with_scores(frame, model).collect()}
    wrong = [i for i, t in labels if i % 4 == 2 and (scores[i] >= 0.3) != bool(t)]
    assert len(wrong) <= 2
    assert model.score("balo vilk0r eri vilkor bonu zumbled") > 0.3 > model.score("")
    assert toxicity.clean_documents(frame, model).count() == sum(s < 0.3 for s in scores.values())


def test_query(spark):
    import pandas as pd

    folder = "/root/testdata/sf0.01"
    found = QUERIES["op6_toxicity"](spark, folder).toPandas()
    assert ((found.score >= 0) & (found.score <= 1)).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    marks = found.merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    held = marks[marks.held_out]
    assert (held.toxic == held.predicted).mean() > 0.9
    clean = held[held.toxic == 0]
    assert clean.predicted.mean() < 0.05


def test_odd_rows(spark, learned, odd_docs, no_docs):  # noqa: F811
    model = learned[2]
    out = toxicity.with_scores(odd_docs, model).collect()
    assert len(out) == 10 and {r.score for r in out if r.doc_id in (3, 4)} == {model.score("")}
    kept = toxicity.clean_documents(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == 10 and toxicity.clean_documents(no_docs, model).count() == 0
    none = toxicity.learn(no_docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    assert none.lexicon == {} and none.score("x") == 0.5
