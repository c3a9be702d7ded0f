"""The operators' queries over whole tables against their SQL."""

import pytest
from oracle import compare, duck

from utterset.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_small, name):
    got = QUERIES[name](spark, sf_small).toPandas()
    if name in ORACLES:
        assert compare(got, duck(sf_small).execute(ORACLES[name]).df()) is None
    assert len(got) > 0
