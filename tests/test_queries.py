import pytest

import __spark_entry__ as entry
from sparkcorpus.queries.base import ORACLES, QUERIES
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    assert oracle.compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_other_queries_have_a_plain_version():
    from tests import test_whole_tables

    assert {f"test_{n}" for n in set(QUERIES) - set(ORACLES)} <= set(dir(test_whole_tables))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
