"""Every registered query against its SQL oracle at the smallest scale."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from checks import compare  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    note, n, *_ = compare.difference(spark, con, queries()[name], SQL.get(name), SF_DIR)
    assert note == "" and n >= 0


def test_entry(spark):
    assert 0 < entry(spark).count() <= 5
