"""Toxicity, quality rules, near-duplicates, mixing and packing over ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vocalith.llm import mixing, packing, quality, similar, toxicity
from vocalith.llm.common import remove, shared_dir, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not predict toxic."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the full policy does not refuse."""
    return quality.keep(docs, quality.FULL)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 or more on five words) the document with the smallest id."""
    return similar.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which the sources' blocks interleave."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and place of each document; a bucket's batches fill in the mixed order."""
    return packing.pack(docs, position=packing.stored_position(docs))


STAGES = [
    ("toxicity", not_toxic),
    ("quality", good_quality),
    ("simhash", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]
#: Fingerprints and zstandard lengths have no SQL form; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``, each but the last written to the shared folder and read again.

    A stage's files are deleted when the next stage has been written; those of the last but one stay,
    since the result reads them.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if i:
            remove(spark, f"{folder}/{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
