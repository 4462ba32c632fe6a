"""Queries of the training-data operators: equal to DuckDB where there is SQL, else they run and are not empty."""

import pytest

from lumigraph.llm import registry
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.01")
    if name in registry.oracle_sql():
        assert_same(df, con, registry.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_found_columns(spark):
    q = registry.queries()
    want = {
        "p1_found": ["first_row_id", "copy_row_id"], "p3_found": ["row_id", "field_name"], "p4_found": ["row_id"], "p6_found": ["target_id"],
        "p7_found": ["row_id", "field_name"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id_a", "doc_id_b"],
    }
    for n, cols in want.items():
        assert q[n](spark, "/root/testdata/sf0.001").columns == cols
