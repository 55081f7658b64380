"""Every query of the package runs on whole tables and agrees with its SQL."""

import pytest

from checks.run import compare, connect
from fieldlark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert ok, note


def test_entry_lists_them():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
