"""Every registered query against its SQL on the smallest test data."""

import os

import pytest

import check
from registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = check.compare(spark, con, name, SF)
    assert ok, note


def test_every_query_has_its_sql():
    assert sorted(set(QUERIES) - set(ORACLES)) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
