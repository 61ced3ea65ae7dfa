"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference, spark_rows, sql_rows
from tidemill.registry import QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# The smallest set has no stock in the region and subsector these ask for.
NEED_LARGER = {"inventory_check", "inventory_slice"}


@pytest.fixture(scope="module")
def connections():
    return {folder: connect(folder) for folder in (SMALL, LARGER)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) >= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connections, name):
    folder = LARGER if name in NEED_LARGER else SMALL
    mine = spark_rows(entry.queries()[name](spark, folder))
    assert difference(mine, sql_rows(connections[folder], entry.oracle_sql()[name])) is None
    assert sum(mine[1].values()) > 0
