"""Every registered query against its SQL statement."""

from __future__ import annotations

import pytest
from check_oracles import connect
from check_oracles import compare

import __spark_entry__ as entry
from sparkmeter import plans

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = set(plans.QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert OWN <= set(QUERIES)
    assert set(ORACLES) <= set(QUERIES)
    assert OWN == set(ORACLES) & OWN


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(name, spark, sf, con):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
