"""Every registered query against its SQL; the others against rules they must keep."""

import os

import pytest

import __spark_entry__ as entry
from blendwise.plans.registry import collect
from tests.compare import database, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = collect()


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows
    assert all(value is not None for row in rows for value in row)
    if name == "r5_simulate":
        assert sum(row.n for row in rows) == 100_000
    if name == "r6_recommend_mixture":
        for kind in ("Human", "Optimal"):
            assert sum(row.weight for row in rows if row.type == kind) == pytest.approx(1, abs=1e-6)
        assert len({(row.target, row.n_scored, row.rho) for row in rows}) == 1 and -1 <= rows[0].rho <= 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
