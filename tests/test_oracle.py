"""Every registered query against its SQL twin on the smallest data set."""

import os

import pytest
from oracle import connect, difference

from shutterlake.catalog import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry()

# The page begins behind the last pair of the smallest set.
MAY_BE_EMPTY = {"f2_pair_page"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    found = difference(QUERIES[name](spark, SF), con, SQL[name])
    assert found is None or (found == "EMPTY" and name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
