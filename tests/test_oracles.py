"""Every screening query against its SQL, over whole tables."""

from __future__ import annotations

import pytest

from sieveline.plans import oracle
from sieveline.plans.queries import QUERIES
from tests import support


@pytest.fixture(scope="module")
def db(sf_dir):
    return support.database(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, db, sf_dir, name):
    support.same(QUERIES[name](spark, sf_dir), db, oracle.SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
