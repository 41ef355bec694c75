import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from fixtures.queries import QUERIES
from oracle import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, connection, name):
    assert differences(spark, connection, name, SF_DIR) == []


def test_entry_has_rows(spark):
    assert len(entry.entry(spark).collect()) == 3
