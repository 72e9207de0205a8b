"""Every query with SQL returns the rows that DuckDB returns for it."""

import pytest

from hanmaru.plans import fixtures, sessions, whole  # noqa: F401
from hanmaru.plans.queries import ORACLE, QUERIES


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, duck, same, name):
    assert same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
