"""From raw documents to packed token ids: five stages, each one operator of ``lumenmill.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

* quality_rules: rows that fail the base rules or the isolation forest go.
* line_dedup: later repeats of runs of 50 words or more, wherever lines break, are deleted; a document
  that loses all its words goes.
* near_dedup: of each group of near duplicates (five-word shingles, 0.8) one document stays.
* source_mix: documents are read as often as the mix takes their blocks, up to twice; a row holds
  the words that are taken on one reading.
* byte_bpe: token ids of every row, and the digests of ids and of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenmill.llm import byte_bpe, line_dedup, near_dedup, quality_rules, source_mix
from lumenmill.llm.common import Scratch, small_batches


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.filter_documents(docs, quality_rules.train(docs, labels))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return line_dedup.filter_documents(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.deduplicated(docs, k=5)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return source_mix.mixed_documents(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return byte_bpe.digests(docs, *byte_bpe.public_ranks(), keep_ids=True)


STAGES = [
    ("quality_rules", _quality),
    ("line_dedup", _lines),
    ("near_dedup", _near),
    ("source_mix", _mix),
    ("byte_bpe", _tokens),
]

#: The forest, the signatures and the merges are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns lies in the cluster's shared folder until the next one is written; the last one stays."""
    tables = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir))
        if before is not None:
            tables.drop(before)
        before = docs
    return docs
