"""Registered queries against their SQL on the smallest test data."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from check_queries import duck, table_of
from registry import all_oracles, all_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def database():
    return duck(DATA)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, database, name):
    frame = entry.queries()[name](spark, DATA)
    mine = table_of(frame.columns, [tuple(row) for row in frame.collect()])
    cursor = database.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert mine == table_of(columns, cursor.fetchall())
