"""A corpus pipeline of five stages over ``documents``: what one stage keeps is written and is the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import decontaminate, packing, secret_scan, simhash, toxicity
from seqspark.llm.common import table, written

#: Rows that meet Python at a time. Spark's own 10,000 whole texts are tens of MB, held by the JVM and by the worker, in and out.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` to ``BATCH_ROWS``; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on this stage's documents, rejects go."""
    _small_batches(spark)
    return toxicity.reject_toxic(docs, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    _small_batches(spark)
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, and ``n_chars`` follows its text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of 2048."""
    _small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("packing", pack)]

#: Training a classifier and hashing with XXH64 have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
