"""Every query with SQL beside it gives the same rows as that SQL."""

import pytest
from check_oracles import compare, connect

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_as_sql(spark, db, sf_dir, name):
    assert compare(spark, db, sf_dir, name) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 10
    scores = [r.weighted_score for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_every_sql_has_a_query():
    from cohortlens.oracles import ORACLES

    assert set(ORACLES) <= set(contract.queries())
