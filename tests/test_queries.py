"""Every registered query at the smallest scale, against its SQL where there is one."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    rows, message = compare(spark, con, sf, QUERIES[name], ORACLES.get(name))
    # lookbacks longer than the shortest fixture may leave nothing to show
    if message == "no rows" or message.startswith("all NULL"):
        pytest.skip(message)
    assert not message, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 3
    assert df.columns[0] == "symbol"
