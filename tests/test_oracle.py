"""Every query with SQL gives the rows of that SQL in DuckDB."""

from __future__ import annotations

import os

import pytest
from compare import database, differences

from sessionweave.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():  # noqa: ANN201
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):  # noqa: ANN001
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):  # noqa: ANN001
    assert QUERIES[name](spark, FOLDER).count() >= 0
