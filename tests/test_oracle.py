"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import compare, duck
from conftest import SMALL

from weirworks.plans.load import REGISTRY


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    verdict, _, count = compare(spark, con, SMALL, name)
    assert verdict in ("ok", "rows only"), verdict
    assert count >= 0


def test_entry_point_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert [n for n in REGISTRY if n not in entry.oracle_sql()] == []
