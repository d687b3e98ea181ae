import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from helpers_llm import no_docs, odd_docs, small_docs  # noqa: F401
from pyspark.sql import functions as F

from weirworks import session
from weirworks.llm import bwt, repeats
from weirworks.llm.anchors import WINDOW, pieces, shared_parts


def brute(docs):
    first = {}
    for i, t in docs:
        data = (t or "").encode()
        for p in range(len(data) - WINDOW + 1):
            key = data[p : p + WINDOW]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        data = (t or "").encode()
        depth = np.zeros(len(data) + 1, int)
        for p in range(len(data) - WINDOW + 1):
            if first[data[p : p + WINDOW]] < i:
                depth[p] += 1
                depth[p + WINDOW] -= 1
        gone = np.cumsum(depth[:-1]) > 0
        edge = np.diff(np.r_[False, gone, False].astype(int))
        out.append((i, len(data), np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return sorted(out)


def found(docs):
    return sorted((r.doc_id, r.n_bytes, list(r.start), list(r.stop), bytes(r.kept)) for r in repeats.without_repeats(docs).collect())


def test_query(small_docs):  # noqa: F811
    assert found(small_docs) == brute([(r.doc_id, r.text) for r in small_docs.collect()])


def test_merged_transforms_are_the_transform_of_the_whole():
    luck = random.Random(3)
    strings = [bytes(luck.choice(b"ab") for _ in range(luck.randint(0, 30))) for _ in range(40)]
    shards, places = [], []
    for at in range(0, 40, 7):
        data, number, place = bwt.collection(strings[at : at + 7])
        symbols, order = bwt.transform(data, number)
        shards.append(symbols)
        places.append([(n + at, p) for n, p in zip(number[order].tolist(), place[order].tolist(), strict=True)])
    interleave, prefix = bwt.merge(shards, 12)
    at = [0] * len(shards)
    suffixes = []
    for k in interleave.tolist():
        n, p = places[k][at[k]]
        suffixes.append(strings[n][p:])
        at[k] += 1
    assert [s[:12] for s in suffixes] == sorted(s[:12] for s in suffixes)
    for a, b, common in zip(suffixes, suffixes[1:], prefix[1:].tolist(), strict=False):
        true = next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
        assert common == min(true, 12)


def test_repeated_strings_and_trimming(monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_PIECES", 6)
    luck = random.Random(2)
    base = [bytes(luck.choice(b"abcd") for _ in range(84)) for _ in range(5)]
    strings, doc = [], []
    for _ in range(60):
        s = bytearray(luck.choice(base))
        if luck.random() < 0.7:
            s[luck.randrange(len(s))] = luck.choice(b"abcx")
        strings.append(bytes(s))
        doc.append(luck.randint(0, 20))
    doc = np.array(doc)
    first = {}
    for s, d in zip(strings, doc, strict=True):
        for p in range(len(s) - WINDOW + 1):
            first[s[p : p + WINDOW]] = min(first.get(s[p : p + WINDOW], 99), d)
    want = {(n, p) for n, (s, d) in enumerate(zip(strings, doc, strict=True)) for p in range(len(s) - WINDOW + 1) if first[s[p : p + WINDOW]] < d}
    number, place = repeats.repeated_strings(strings, doc)
    assert set(zip(number.tolist(), place.tolist(), strict=True)) == want


def test_every_string_lies_in_one_piece_of_its_anchor():
    luck = random.Random(4)
    texts = [bytes(luck.choice(b"ab c") for _ in range(luck.choice([0, 49, 50, 51, 400]))) for _ in range(30)]
    p = pieces(texts)
    by_string = {}
    covered = set()
    for n in range(len(p["lo"])):
        for at in range(p["lo"][n], p["hi"][n] + 1):
            covered.add((int(p["doc"][n]), at))
            key = texts[p["doc"][n]][at : at + WINDOW]
            assert by_string.setdefault(key, (p["anchor"][n], p["at"][n] - at)) == (p["anchor"][n], p["at"][n] - at)
    assert covered == {(d, at) for d, t in enumerate(texts) for at in range(len(t) - WINDOW + 1)}
    # Two pieces whose anchors differ share nothing; a piece and its copy in another document share all of it.
    cut = lambda n: texts[p["doc"][n]][p["lo"][n] : p["hi"][n] + WINDOW]
    other = next(n for n in range(len(p["lo"])) if p["anchor"][n] != p["anchor"][0])
    assert len(shared_parts([cut(0), cut(other)], np.array([1, 2]))[0]) == 0
    kept, low, high = shared_parts([cut(0), cut(0)], np.array([1, 2]))
    assert kept.tolist() == [0, 1] and low.tolist() == [0, 0] and high.tolist() == [len(cut(0))] * 2


def test_crowded_anchors_and_hot_passages(spark):
    """More documents around one passage than a bucket takes at once."""
    luck = random.Random(5)
    passage = "this very passage of seventy odd characters is found in all documents."
    word = lambda: "".join(luck.choice("abcdefghij") for _ in range(7))
    docs = [(i, f"{word()} {word()} {word()} {passage} {word()} {word()} {word()}") for i in range(repeats.MANY + 300)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)


def test_odd_rows(odd_docs, no_docs):  # noqa: F811
    got = found(odd_docs.where("doc_id IS NOT NULL AND doc_id <> 7"))
    rows = odd_docs.where("doc_id IS NOT NULL AND doc_id <> 7").collect()
    assert [g[0] for g in got] == sorted(r.doc_id for r in rows)
    by_id = {g[0]: g for g in got}
    assert by_id[1][2] == [] and by_id[2][2:4] == ([0], [len(rows[0].text)]) and by_id[3][1] == 0 and by_id[6][2] == []
    assert repeats.without_repeats(odd_docs).count() == 10 and repeats.without_repeats(no_docs).count() == 0


def test_no_part_holds_the_pieces_of_a_crowd(spark):
    """A passage in all documents has a different piece at its edge in each; they must not travel by anchor."""
    luck = random.Random(6)
    passage = "this very passage of seventy odd characters is found in all documents."
    word = lambda: "".join(luck.choice("abcdefghij") for _ in range(7))
    docs = [(i, i, f"{word()} {word()} {word()} {passage} {word()} {word()} {word()}") for i in range(5 * repeats.MANY)]
    rows = spark.createDataFrame(docs, "doc_id long, text_id long, text string").repartition(3)
    shipped = rows.mapInPandas(repeats._shipped(2, repeats.crowded_anchors(rows)), repeats.SHIPPED).toPandas()
    held = np.concatenate([repeats._unpack(p)["anchor"] for p in shipped["payload"] if p is not None])
    assert np.unique(held, return_counts=True)[1].max() <= 2 * repeats.MANY
    assert shipped["anchor"].notna().any()


def test_every_anchor_sent_apart_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "MANY", 2)
    luck = random.Random(7)
    base = ["".join(luck.choice("abcdef ") for _ in range(150)) for _ in range(4)]
    docs = [(i, luck.choice(base)[luck.randrange(40) :] + str(luck.random()) * 4 + luck.choice(base)) for i in range(60)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)


def test_strings_are_handed_on_in_bounded_frames():
    """A passage in a third of 20,000 documents: what a task makes of its rows is cut by strings made, not by rows."""
    text = "x" * 400
    refs = [{"lo": np.array([0]), "hi": np.array([300]), "bucket": np.array([-1])}]
    rows = [(n, n, text, refs) for n in range(6_667)]
    batch = pd.DataFrame(rows, columns=["doc_id", "text_id", "text", "refs"])
    sizes = [len(f) for f in repeats._cut_out(1)(iter([batch]))]
    assert sum(sizes) == 6_667 * 301 and max(sizes) <= repeats.STRINGS + 301


def test_equal_pieces_leave_a_crowd_before_it_is_cut(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "MANY", 2)
    luck = random.Random(9)
    copy = "".join(luck.choice("abcdef ") for _ in range(400))
    docs = [(i, copy if i % 3 else "".join(luck.choice("abcdef ") for _ in range(90)) + copy[i : i + 120]) for i in range(90)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == brute(docs)


def test_marks_are_flat_and_places_next_to_each_other_are_one():
    luck = random.Random(6)
    shared = bytes(luck.choice(b"abcd") for _ in range(70))
    texts = [b"xy" + shared, b"z" + shared + b"q"]
    p = pieces(texts)
    cut = [(0, d + 1, d + 11, lo, texts[d][lo : hi + WINDOW]) for d, lo, hi in zip(p["doc"].tolist(), p["lo"].tolist(), p["hi"].tolist(), strict=True)]
    got = repeats._bucket(pd.DataFrame(cut, columns=["bucket", "doc_id", "text_id", "lo", "piece"]))
    assert (got["doc_id"] == 2).all() and (got["text_id"] == 12).all() and len(got) == 1
    assert (got["lo"][0], got["hi"][0]) == (1, 21)


def test_runs_around_an_anchor_leave_a_crowd_before_it_goes_string_by_string(spark, monkeypatch):
    """Near copies: nearly all strings beside an edit are repeats, but few of them are joined one by one."""
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "MANY", 2)
    steps, cut = [], repeats.cut_lineage
    monkeypatch.setattr(repeats, "cut_lineage", lambda df: steps.append(cut(df)) or steps[-1])
    luck = random.Random(11)
    word = lambda: "".join(luck.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(150)]

    def joined(n: int) -> int:
        docs = [(0, " ".join(base))]
        for i in range(1, n):
            words = list(base)
            for at in range(luck.randrange(25), 150, 25):
                words[at] = word()
            docs.append((i, " ".join(words)))
        steps.clear()
        assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == brute(docs)
        return steps[-1].count()

    few, many = joined(60), joined(120)
    # Six edits a document, at each 3.5 strings or so on either side that share a run with a changed one; before, 15 or so.
    assert 0 < few < 60 * 6 * 2 * 7 and many < 2.5 * few


def test_runs_are_counted_from_the_anchor():
    luck = random.Random(12)
    shared = bytes(luck.choice(b"abcd") for _ in range(90))
    texts = [b"xyz" + shared, b"q" * 20 + shared + b"rs"]
    p = pieces(texts)
    rows = []
    for d, text in enumerate(texts):
        mine = p["doc"] == d
        rows.append((d, d, text.decode(), [{"lo": p["lo"][mine], "hi": p["hi"][mine], "bucket": np.full(mine.sum(), -1)}]))
    got = pd.concat(repeats._cut_out(1, repeats.RUN)(iter([pd.DataFrame(rows, columns=["doc_id", "text_id", "text", "refs"])])))
    # Every string lies in one row, and rows hold RUN strings at most.
    places = sorted((d, lo + k) for d, lo, piece in zip(got["doc_id"], got["lo"], got["piece"], strict=True) for k in range(len(piece) - WINDOW + 1))
    assert places == [(d, at) for d, t in enumerate(texts) for at in range(len(t) - WINDOW + 1)]
    assert got["piece"].map(len).max() == WINDOW + repeats.RUN - 1
    assert all(texts[d][lo : lo + len(piece)] == piece for d, lo, piece in zip(got["doc_id"], got["lo"], got["piece"], strict=True))
    # Of the 41 shared strings, all but those of the outermost runs are in equal rows.
    ours, theirs = (set(got.loc[got["doc_id"] == d, "piece"]) for d in (0, 1))
    assert sum(len(x) - WINDOW + 1 for x in ours & theirs) >= 41 - 2 * repeats.RUN


def test_pieces_of_a_part_are_ordered_by_anchor_and_whole_piece():
    luck = np.random.default_rng(13)
    anchor = luck.integers(0, 40, 3000).astype(np.uint64) << np.uint64(30)
    # Many whole pieces that agree in their lower 16 bits.
    whole = (luck.integers(0, 6, 3000).astype(np.uint64) << np.uint64(16)) | luck.integers(0, 3, 3000).astype(np.uint64)
    order = repeats._by_anchor(anchor, whole)
    assert sorted(order.tolist()) == list(range(3000))
    pairs = list(zip(anchor[order].tolist(), whole[order].tolist(), strict=True))
    assert [a for a, _ in pairs] == sorted(anchor.tolist())
    assert sum(repeats._groups(anchor[order], whole[order])) == len(set(pairs))


def test_a_document_is_numbered_anew_in_each_part(spark):
    luck = random.Random(14)
    docs = [(i * 7, i, "".join(luck.choice("abcdefgh ") for _ in range(400))) for i in range(50)]
    batch = pd.DataFrame(docs, columns=["doc_id", "text_id", "text"])
    out = pd.concat(repeats._shipped(5, np.array([], np.uint64))(iter([batch])))
    want, got = pieces([t.encode() for _, _, t in docs]), []
    for ids, texts, data in zip(out["docs"], out["texts"], out["payload"], strict=True):
        p = repeats._unpack(data)
        got += zip(np.asarray(ids)[p["doc"]].tolist(), np.asarray(texts)[p["doc"]].tolist(), p["lo"].tolist(), p["hi"].tolist(), strict=True)
    assert sorted(got) == sorted((d * 7, d, lo, hi) for d, lo, hi in zip(want["doc"].tolist(), want["lo"].tolist(), want["hi"].tolist(), strict=True))


def test_a_bucket_without_a_repeat():
    """Pieces that share the bytes beside their anchor, as words at an edit do, but no 50-byte string."""
    luck = random.Random(15)
    middle = bytes(luck.choice(b"abcd") for _ in range(44))
    texts = [bytes(luck.choice(b"efgh") for _ in range(20)) + middle + bytes(luck.choice(b"efgh") for _ in range(20)) for _ in range(2)]
    p = pieces(texts)
    cut = [(0, d + 1, d + 11, lo, texts[d][lo : hi + WINDOW]) for d, lo, hi in zip(p["doc"].tolist(), p["lo"].tolist(), p["hi"].tolist(), strict=True)]
    rows = pd.DataFrame(cut, columns=["bucket", "doc_id", "text_id", "lo", "piece"])
    assert len(shared_parts([bytes(x) for x in rows["piece"]], rows["doc_id"].to_numpy())[0])
    got = repeats._bucket(rows)
    assert len(got) == 0 and list(got.columns) == ["doc_id", "text_id", "lo", "hi"]


def test_pieces_of_many_parts_stay_small():
    """At thousands of parts each piece travels with an id of its own: that and what hardly varies must compress."""
    luck = random.Random(8)
    words = ["".join(luck.choice("abcdefghij") for _ in range(6)) for _ in range(3_000)]
    rows = [(10_000_000 + 3 * n, 0, " ".join(luck.choices(words, k=300))) for n in range(500)]
    made = repeats._shipped(400, np.array([], np.uint64))
    sent = pd.concat(getattr(repeats, "_sent", lambda f: f)(made)(iter([pd.DataFrame(rows, columns=["doc_id", "text_id", "text"])])))
    size = lambda v: v if isinstance(v, bytes) else np.asarray(v, np.int64).tobytes()
    packed = [len(pa.compress(b"".join(map(size, sent[c])), codec="lz4", asbytes=True)) for c in ("docs", "texts", "payload")]
    held = [repeats._unpack(p) for p in sent["payload"]]
    assert sum(packed) < 22 * sum(len(h["anchor"]) for h in held)
    # What comes out is what went in.
    want = pieces([t.encode() for _, _, t in rows])
    ids = [repeats._unpack_ids(d)[h["doc"]] for d, h in zip(sent["docs"], held, strict=True)]
    got = {k: np.concatenate([h[k] for h in held]).tolist() for k in ("lo", "hi", "anchor", "whole")}
    low = np.uint64((1 << 48) - 1)
    want = (np.array([r[0] for r in rows])[want["doc"]], want["lo"], want["hi"], want["anchor"] & low, want["whole"] & low)
    assert sorted(zip(np.concatenate(ids).tolist(), *got.values(), strict=True)) == sorted(zip(*(w.tolist() for w in want), strict=True))


def test_ids_and_places_of_any_size_are_packed():
    ids = np.array([-(2**63), 2**63 - 1, -1, 5, 5, 2**62], np.int64)
    assert repeats._unpack_ids(repeats._pack_ids(ids)).tolist() == ids.tolist()
    p = {"anchor": np.arange(6, dtype=np.uint64) << np.uint64(40), "whole": np.arange(6, dtype=np.uint64), "left": np.arange(6, dtype=np.uint16), "right": np.full(6, 65_535, np.uint16)}
    p |= {"doc": np.array([0, 0, 1, 2, 3, 3]), "lo": np.array([0, 70_000, 2**31 - 99, 3, 4, 90]), "hi": np.array([34, 70_001, 2**31 - 99, 30, 9, 95])}
    out = repeats._unpack(repeats._pack(p))
    assert all(out[k].tolist() == v.tolist() for k, v in p.items())


def test_an_anchor_alone_sends_no_bytes():
    """Documents that share 16 bytes, but with neither side of them, have no string to compare; with one side they have."""
    luck = random.Random(9)
    word = lambda n: "".join(luck.choice("abcdefghij") for _ in range(n))
    texts = [word(40) + "sixteen bytes..." + word(40) for _ in range(3_000)]
    side = word(20)
    texts += [word(40) + "sixteen bytes..." + side + word(20) for _ in range(50)]
    batch = pd.DataFrame([(n, 0, t) for n, t in enumerate(texts)], columns=["doc_id", "text_id", "text"])
    made = pd.concat(getattr(repeats, "_sent", lambda f: f)(repeats._shipped(1, np.array([], np.uint64)))(iter([batch])))
    compared = repeats._compared(made.reset_index(drop=True))
    asked = compared[compared["bucket"].notna()]
    _, n = np.unique(pieces([t.encode() for t in texts])["anchor"], return_counts=True)
    assert n.max() > 20
    # By two equal hashes of 16 bits one may come along that need not.
    assert len(set(asked["doc_id"]) - set(range(3_000, 3_050))) < 10 and len(asked) >= 2


def test_both_ways_of_telling_rows_of_one_id_apart(spark, monkeypatch):
    luck = random.Random(10)
    base = ["".join(luck.choice("abcdef ") for _ in range(150)) for _ in range(5)]
    docs = [(luck.choice([n, n, 7, 9]), luck.choice(base)[luck.randrange(40) :] + str(luck.random()) * 3 + luck.choice(base)) for n in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(frame) == brute(docs)
    monkeypatch.setattr(repeats, "SHARED_IDS", 1)
    assert found(frame) == brute(docs)


def test_shuffle_files_of_a_step_go_with_it(spark):
    """Else those of all steps stand on the disk until the driver collects its garbage."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in blocks.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and "/shuffle_" in f}

    before, kept = shuffled(), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with session.lean_steps(spark):
        step = session.cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and step.count() == 7
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == kept


def test_no_step_of_the_operator_leaves_shuffle_files(spark, monkeypatch):
    """Only the last query, which the caller runs, may."""
    settings = []
    write = repeats.cut_lineage
    monkeypatch.setattr(repeats, "cut_lineage", lambda df: settings.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) or write(df))
    text = "".join(random.Random(11).choice("abcdefgh") for _ in range(200))
    assert len(found(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))) == 2
    assert len(settings) > 3 and set(settings) == {"true"}
