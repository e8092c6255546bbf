"""Every registered query against its SQL equivalent at the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name not in ORACLES:
        assert df.count() > 0
        return
    ok, note, _ = compare(df, con, ORACLES[name])
    assert ok, note


def test_entry_is_lazy_and_counts_products(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.products for r in rows) > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
