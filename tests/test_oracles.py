"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, duck
from conftest import SMALL

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    message, _ = compare(spark, con, SMALL, name)
    assert message is None, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["agent", "provider", "input_tokens", "output_tokens", "cost_usd", "calls"]
    assert df.count() == 25
