"""Every registered query against its SQL oracle at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from lectern.plans.queries import QUERIES
from tests.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


OWN = list(QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, name, FOLDER)[0] is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(entry.oracle_sql()) <= set(entry.queries())
