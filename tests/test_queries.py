"""Every registered query against its SQL on the smallest tables."""

import pytest

from quern.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    compare(con, ORACLES[name], QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() >= 0 and df.columns


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())
