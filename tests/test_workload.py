"""Every registered query against its SQL, at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, duck  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, connection, name):
    status, _, _, detail = compare(spark, connection, SF, name)
    assert status in ("ok", "rows"), detail


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(oracle_sql()) <= set(queries())
