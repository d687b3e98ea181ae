import hashlib
import zlib

import pytest
from helpers_llm import SMALL, con, same_as_sql  # noqa: F401
from pyspark.sql import functions as F

from weirworks.llm import merkle
from weirworks.llm.queries import MANIFEST_COLUMNS, QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][n : n + 8])) for n in range(0, len(out[-1]), 8)])
    return out


def path(tree, at):
    out = []
    for level in tree[:-1]:
        run = level[at // 8 * 8 :][:8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    for lang in by:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {lang: levels([leaf(r) for r in held]) for lang, held in by.items()}
    langs = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for n, lang in enumerate(langs):
        for at, r in enumerate(by[lang]):
            way = path(trees[lang], at) + path(top, n)
            held = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                held = leaf((*r[:4], low))
            for left, right in way:
                held = sha(left + held + right)
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), held, held == top[-1][0]))
    return sorted(out, key=repr)


def query(spark, monkeypatch, df):
    monkeypatch.setattr("weirworks.llm.queries.table", lambda *_: df)
    return sorted(map(tuple, QUERIES["op12_manifest"](spark, SMALL).collect()), key=repr)


def test_query_against_sql(spark, con):  # noqa: F811
    same_as_sql(spark, con, "op12_manifest")


@pytest.mark.parametrize("many", [1, 8, 9, 64, 65, 513, 4_100])
def test_sizes_around_the_written_levels(spark, monkeypatch, many):
    rows = [(n, "s", "en", n, f"Text {n}") for n in range(many)] + [(n, None, lang, None, "B") for lang in (None, "", "é", *map(str, range(70))) for n in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert query(spark, monkeypatch, df) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [
        (None, None, None, None, None),
        (2**60 + 1, "a", "en", 3, ""),
        (2**60 + 1, "a", "en", 3, ""),
        (2**60 + 2, "a", "en", 3, None),
        (5, "ü😀", "en", -7, "X" * 100_000),
        (5, "-", "en", None, "Other"),
        (None, "-", "en", 0, "0:"),
        (2**63 - 1, "", "de", 1, "A\nB"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int, grp string")
    got = query(spark, monkeypatch, df)
    assert got == brute(rows) and len(got) == 8
    assert query(spark, monkeypatch, df.limit(0)) == []
    assert [r[4:6] for r in query(spark, monkeypatch, df.where("lang = 'de'"))] == [(sha(""), leaf((2**63 - 1, "", "de", 1, "a\nb" if zlib.crc32(str(2**63 - 1).encode()) % 3 == 0 else "A\nB")))]


def test_only_every_third_level_is_written(spark):
    rows = spark.range(10_000).select(F.lit("g").alias("grp"), F.col("id").alias("by"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.struct("id").alias("extra"))
    tree = merkle.build(rows, ["by"])
    assert [level.count() for level in tree.levels] == [10_000, 20]
    assert tree.tops.count() == 1 and tree.tops.first().level == 1
    assert levels([sha(str(n)) for n in range(10_000)])[-1][0] == tree.tops.first().top


def test_a_changed_text_does_not_verify(spark):
    out = QUERIES["op12_manifest"](spark, SMALL).toPandas()
    touched = out["doc_id"].map(lambda n: zlib.crc32(str(n).encode()) % 3 == 0)
    assert out.loc[~touched, "verified"].all() and not out.loc[touched, "verified"].all()
    assert len(MANIFEST_COLUMNS) == 5
