"""Every registered query of the library proper on the smallest tables, against its SQL."""

import os

import pytest

import __spark_entry__ as entry
from siftwell.plans import registry
from tests.oracle import compare, connect

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables aren't here")


@pytest.fixture(scope="module")
def con():
    return connect(TABLES)


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_against_sql(spark, con, name):
    assert compare(con, registry.queries()[name](spark, TABLES), registry.sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.sql()) - {"graph_goodness_walks"}))
def test_runs(spark, name):
    assert registry.queries()[name](spark, TABLES).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
