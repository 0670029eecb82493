"""Every registered query against its SQL twin."""

import pytest

from oracle import compare, connect
from sluice.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER) is None


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
