"""Fixtures and helpers of the tests in this folder."""


import duckdb
import pytest


SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels", "benchmark", "pages", "conversations")


@pytest.fixture(scope="session")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return out


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


PROSE = "the quick brown fox jumps over the lazy dog while seven tired cats watch from the old stone wall"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, PROSE, "a", 1.0, "x"),
        (1, PROSE, "a", 1.0, "x"),
        (2, PROSE, "a", None, "x"),
        (3, None, "b", 1.0, "x"),
        (4, "", None, 1.0, None),
        (5, "\n\n  \n" + PROSE, None, 2.0, "x"),
        (6, ("word%d " * 3 % (1, 2, 3)) * 20_000, "c", 1.0, "x"),
        (7, "a" * 200_000, "c", 1.0, "x"),
        (None, PROSE.upper(), "c", 1.0, "x"),
        (8, "mail me@example.org or +1 (555) 010-9999, 10.0.0.1, 4111 1111 1111 1111", "", 1.0, "x"),
    ]
    names = "doc_id long, text string, source string, key double, row string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def same_as_sql(spark, con, name):
    """The query's rows next to those of its SQL, both sorted."""
    from weirworks.llm.queries import ORACLES, QUERIES

    found = QUERIES[name](spark, SMALL).toPandas()
    asked = con.execute(ORACLES[name]).df()[list(found.columns)]
    by = [c for c in found.columns if c not in ("target",)]
    left = found.sort_values(by).reset_index(drop=True)
    right = asked.sort_values(by).reset_index(drop=True)
    assert len(left) == len(right)
    for c in found.columns:
        assert (left[c].astype(str) == right[c].astype(str)).all(), c
