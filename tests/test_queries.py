"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks import compare, oracles, queries


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.database(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ALL))
def test_agrees_with_sql(spark, sf_dir, connection, name):
    assert compare.difference(spark, connection, name, sf_dir) is None


def test_contract(spark):
    assert contract.entry(spark).columns[:2] == ["position", "column_name"]
    assert set(queries.ALL) <= set(contract.queries())
    assert set(oracles.ALL) == set(queries.ALL)
