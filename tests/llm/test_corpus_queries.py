"""Registered corpus queries against their SQL, and the pipeline, on the smallest driver tables."""

import os

import pytest

import corpus_pipeline
from dosescreen.llm.queries import QUERIES, SQL
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, name):
    problem, count = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], SQL[name])
    assert problem is None, problem
    assert count > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, FOLDER)
        assert left.columns == docs.columns and 0 < left.count() <= docs.count(), name
    mixed = corpus_pipeline.run(spark, FOLDER)
    assert 0 < mixed.count() < docs.count() and mixed.where("taken > 3 * size").count() == 0
