"""A corpus from raw documents in five stages; each reads what the stage before it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosescreen.llm import decontaminate, mixture, secret_scan, simhash, toxicity
from dosescreen.llm.common import table
from dosescreen.session import STAGE_PREFIX, drop_stages, stage_tables, use_checkpoints


def mild(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the limit."""
    return toxicity.keep_mild(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of linked SimHash fingerprints."""
    return simhash.keep_one(docs, most=simhash.DISTANCE, shingle=simhash.SHINGLE)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    safe_docs = secret_scan.redact(docs)
    return safe_docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken (repeats counted)."""
    plan = mixture.mix(mixture.weighted(docs, table(spark, sf_dir, "labels")))
    return plan.where("taken > 0").select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", mild), ("simhash", distinct), ("decontamination", clean), ("secrets", safe), ("mixture", mixed)]

#: SQL expresses neither the fitted model nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again.

    A stage's own tables, and the output of the stage before it, go as soon as its output is written.
    """
    docs = table(spark, sf_dir, "documents")
    before = stage_tables(spark)
    for name, stage in STAGES:
        output = f"{STAGE_PREFIX}{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(f"{use_checkpoints(spark)}/{output}")
        docs = spark.read.parquet(f"{use_checkpoints(spark)}/{output}")
        drop_stages(spark, before | {output})
    return docs
