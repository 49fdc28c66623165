"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

from __spark_entry__ import entry
from tools.compare import compare, connect
from workload import all_queries as queries, all_sql as oracle_sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, database, name):
    problem, count = compare(spark, database, FOLDER, queries()[name], oracle_sql()[name])
    assert problem is None, problem
    assert count > 0 or name in {"qc_unexpected_nulls"}
