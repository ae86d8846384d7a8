"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import compare
from registry.oracle import ORACLE
from registry.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connection(FOLDER)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLE:
        assert compare.differences(df, con, ORACLE[name]) == []
    else:
        assert len(df.columns) > 0 and df.collect() is not None
