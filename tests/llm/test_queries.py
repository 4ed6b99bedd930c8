"""Every registered query of the subpackage on the smallest tables, against its SQL where it has one."""

import os

import pytest

from siftwell.llm import queries
from tests.oracle import compare, connect

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables aren't here")


@pytest.fixture(scope="module")
def con():
    return connect(TABLES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    assert compare(con, queries.QUERIES[name](spark, TABLES), queries.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, TABLES).count() > 0
