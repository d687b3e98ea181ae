import re

import pytest
from conftest import plan, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from weirworks.functions.predicates import Ref, cond, predicate
from weirworks.operators.filters import filter_rows, route

DATA = [(1, "paid", 10.5, "a"), (2, "open", None, "paid"), (3, None, 0.0, None), (4, "", -2.0, ""), (5, "50%_x", 99.0, "50%_x")]
SCHEMA = "id int, status string, amount double, other string"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(DATA, SCHEMA).cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_missing_values_follow_two_valued_logic(frame):
    assert ids(filter_rows(frame, [cond("status", "NE", "paid")])) == [2, 3, 4, 5]
    assert ids(filter_rows(frame, [cond("amount", "GT", 0, negated=True)])) == [2, 3, 4]
    assert ids(filter_rows(frame, [cond("status", "CONTAINS", "on")])) == []
    assert ids(filter_rows(frame, [cond("status", "IN", ["paid", "open"], negated=True)])) == [3, 4, 5]


def test_no_conditions_keep_everything(frame):
    assert ids(filter_rows(frame, [])) == [1, 2, 3, 4, 5]


def test_column_against_column(frame):
    assert ids(filter_rows(frame, [cond("status", "EQ", Ref("other"))])) == [3, 4, 5]
    assert ids(filter_rows(frame, [cond("id", "GT", Ref("amount"))])) == [3, 4]
    assert ids(filter_rows(frame, [cond("amount", "EQ", Ref("status"))])) == []


def test_constants_of_another_type(frame):
    assert ids(filter_rows(frame, [cond("id", "EQ", "2")])) == [2]
    assert ids(filter_rows(frame, [cond("id", "EQ", "two")])) == []
    assert ids(filter_rows(frame, [cond("id", "NE", "two")])) == [1, 2, 3, 4, 5]
    assert ids(filter_rows(frame, [cond("id", "GT", 2.5)])) == [3, 4, 5]
    with pytest.raises(ValueError):
        predicate(frame, [cond("id", "LT", "two")])
    with pytest.raises(ValueError):
        predicate(frame, [cond("id", "ROUGHLY", 2)])


def test_like_has_no_escape_and_wildcards_work(spark):
    df = spark.createDataFrame([(1, "a\\%b"), (2, "a%b"), (3, "axb")], "id int, s string")
    assert ids(filter_rows(df, [cond("s", "LIKE", "a_b")])) == [2, 3]
    assert ids(filter_rows(df, [cond("s", "LIKE", "a\\%")])) == [1]
    assert ids(filter_rows(df, [cond("s", "ILIKE", "A%B")])) == [1, 2, 3]


def test_plain_conditions_reach_the_scan(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    kept = filter_rows(orders, [cond("o_totalprice", "GT", 1000), cond("o_orderstatus", "EQ", "F")])
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan(kept))[1]
    assert "GreaterThan(o_totalprice,1000" in pushed and "o_orderstatus" in pushed


def test_route_names_groups_and_the_rest(frame):
    frames = route(frame, {"big": ("AND", [cond("amount", "GTE", 10)]), "named": ("OR", [cond("status", "EQ", "paid"), cond("other", "EQ", "paid")])})
    assert {k: ids(v) for k, v in frames.items()} == {"big": [1, 5], "named": [1, 2], "default_group": [3, 4]}


# A Python reading of the rules, to compare with over many made-up conditions.
def holds(row, c):
    x = row[c.path]
    if c.op in ("NULL", "NOT_NULL"):
        out = (x is None) == (c.op == "NULL")
    elif c.op in ("EQ", "NE"):
        out = (x == c.values[0]) == (c.op == "EQ")
    elif x is None:
        out = False
    else:
        y = c.values[0]
        out = {
            "LT": lambda: x < y, "LTE": lambda: x <= y, "GT": lambda: x > y, "GTE": lambda: x >= y, "IN": lambda: x in c.values,
            "BETWEEN": lambda: c.values[0] <= x <= c.values[-1], "CONTAINS": lambda: str(y) in x, "STARTS_WITH": lambda: x.startswith(str(y)),
            "ENDS_WITH": lambda: x.endswith(str(y)),
        }[c.op]()
    return out != c.negated


words = st.sampled_from(["", "a", "ab", "b", "ba", "paid"])
numbers = st.integers(-2, 3)
text_conditions = st.builds(cond, st.just("s"), st.sampled_from(["EQ", "NE", "LT", "GTE", "IN", "CONTAINS", "STARTS_WITH", "ENDS_WITH", "NULL", "NOT_NULL"]), words, negated=st.booleans())
number_conditions = st.builds(cond, st.just("n"), st.sampled_from(["EQ", "NE", "LT", "LTE", "GT", "GTE", "IN", "BETWEEN", "NULL"]), numbers, numbers, negated=st.booleans())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(text_conditions, number_conditions), min_size=1, max_size=4), st.sampled_from(["AND", "OR"]))
def test_any_filter_agrees_with_python(spark, conditions, combine):
    table = [(i, s, n) for i, (s, n) in enumerate((s, n) for s in ("", "a", "ab", "ba", None) for n in (-1, 0, 2, None))]
    df = spark.createDataFrame(table, "id int, s string, n int")
    want = [i for i, s, n in table if (all if combine == "AND" else any)(holds({"s": s, "n": n}, c) for c in conditions)]
    assert ids(filter_rows(df, conditions, combine)) == want


def test_rows_helper_sorts(spark):
    assert rows(spark.createDataFrame([(2,), (1,)], "a int")) == [(1,), (2,)]
