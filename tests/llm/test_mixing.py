from helpers_llm import con, no_docs, odd_docs, same_as_sql, small_docs  # noqa: F401

from weirworks.llm.mixing import mix, mixed_documents


def test_query(spark, con):
    same_as_sql(spark, con, "op5_mixing")


def test_targets_are_met_and_reruns_agree(spark):
    docs = [(i, "word " * (1 + i % 40), f"s{i % 7 if i % 3 else 0}") for i in range(3_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mix(frame).toPandas()
    again = mix(frame.repartition(5)).toPandas()
    assert out.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert abs(out.groupby("source").target.first().sum() - 1.5 * out["size"].sum()) < 1e-6
    per = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((per.taken - per.target).abs() <= 20).all()
    assert (per.target <= 2 * per["size"] + 1e-9).all() and (out.taken <= 2 * out["size"]).all()
    # Whole epochs come before part of one: no document lags another of its source by more than one turn.
    assert (out.groupby("source").epochs.agg(lambda e: e.max() - e.min()) <= 1).all()


def test_level_with_full_and_open_sources(spark):
    docs = [(1, "a b c d e f g h i j", "x"), (2, "a " * 100, "y"), (3, "a " * 1000, None)]
    out = {r.source: r for r in mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert [out[s].target for s in ("x", "y", None)] == [20.0, 200.0, 1.5 * 1110 - 220]


def test_odd_rows(odd_docs, no_docs):
    out = mix(odd_docs).collect()
    assert len(out) == 10 and {r.size for r in out if r.doc_id in (3, 4)} == {0}
    assert mix(no_docs).count() == 0
    kept = mixed_documents(odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    assert kept.columns == odd_docs.columns


def test_null_and_repeated_ids_come_as_often_as_the_mix_takes_them(spark):
    # 400 rows without an id, 400 with one id, and 400 with their own; every text is another one.
    docs = [(None if i < 400 else 7 if i < 800 else i, f"t{i} " + "word " * (4 + i % 5), f"s{i % 2}") for i in range(1_200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    taken = [r.text for r in mixed_documents(frame).collect()]
    words = sum(len(t.split()) for _, t, _ in docs)
    assert max(map(taken.count, set(taken))) <= 2
    assert abs(sum(len(t.split()) for t in taken) - 1.5 * words) <= 20
    assert {None, 7} <= {i for i, t, _ in docs if t in set(taken)}
