"""Every named query against its SQL in DuckDB (or at least a non-empty result)."""

import pytest
from oracle import compare, duck

from utterset.queries import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_oracle_names_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_small, name):
    got = QUERIES[name](spark, sf_small).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        assert compare(got, con.execute(ORACLES[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
