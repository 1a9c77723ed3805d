"""Every registered query against its SQL twin on the smallest data."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    ok, message = compare(spark, QUERIES[name], ORACLES.get(name), sf_dir, con)
    assert ok, message


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 5


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
