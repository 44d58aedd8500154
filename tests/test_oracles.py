"""Every registered query with SQL gives the rows of that SQL."""

import pytest

from cohortlens.catalog import load
from tests.oracle_check import compare

QUERIES, ORACLES = load()

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
