"""The queries that SQL can express, side by side with it."""

import pytest
from oracle import compare, connect

from gridspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf, name):
    assert compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name]) is None
