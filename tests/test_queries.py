import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
#: Queries of the library itself; those of the optional folder have tests of their own.
QUERIES, SQL = entry._QUERIES, entry._SQL


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert verdict == "ok"


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 6000
