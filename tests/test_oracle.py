"""Every registered query at the smallest scale, against its SQL oracle where it has one."""

import pytest

import __spark_entry__ as entry
from chromafield.plans.catalog import COVERS, ORACLES, QUERIES
from tests.check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        problem, _ = compare(df, con, ORACLES[name])
        assert problem is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) == set(COVERS)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
