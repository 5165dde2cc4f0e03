"""Every registered query against its SQL counterpart on the smallest data."""

import pytest

import __spark_entry__ as entry_point
from catalog.registry import ORACLES, QUERIES
from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    diff = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert diff is None, diff


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert {r.stat for r in rows} == {"f4", "f4_root"}


def test_entry_point_has_all_queries():
    assert QUERIES.items() <= entry_point.queries().items() and ORACLES.items() <= entry_point.oracle_sql().items()


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
