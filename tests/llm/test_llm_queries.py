"""Every query of the subpackage against its SQL on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import compare  # noqa: E402
from callboard.llm.oracle import ORACLE  # noqa: E402
from callboard.llm.queries import QUERIES  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connection(FOLDER)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, con, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), con, ORACLE[name]) == []
