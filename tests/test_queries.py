"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Views whose rules leave nothing at this size are compared on the next one.
LARGER = "/root/testdata/sf0.01"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connections():
    return {d: connect(d) for d in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, connections, name):
    problem = compare(spark, connections[SF], SF, entry.queries()[name], ORACLES[name])
    if problem == "no rows":
        problem = compare(spark, connections[LARGER], LARGER, entry.queries()[name], ORACLES[name])
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
