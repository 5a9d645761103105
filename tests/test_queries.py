"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from ambry.plans import ORACLES, QUERIES
from tests.compare import compare, duck

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
