"""Every registered core query runs; those with SQL equal DuckDB."""

import pytest

from lumigraph.plans import catalogue
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    if name in catalogue.oracle_sql():
        assert_same(df, con, catalogue.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
