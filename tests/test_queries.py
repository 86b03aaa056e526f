"""Every registered query against its SQL on the smallest tables."""

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries
from workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    if name in ORACLES:
        assert oracle.difference(spark, small, QUERIES[name], ORACLES[name], con) is None
    else:
        assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
