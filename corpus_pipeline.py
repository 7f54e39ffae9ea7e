"""The corpus pipeline: five operators of tidemark.llm, each stage a Parquet table that the next one reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, mixing, packing, quality, secrets
from tidemark.llm.common import drop_path, dropped_after, shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, quality.train(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs, n=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets replaced in their texts."""
    return secrets.redact(docs, secrets.train(secrets.rule_findings(spark), secrets.learn_words(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal shares, shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram jaccard join", keep_one_of_each_group),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizers and classifiers can't be written in SQL; tests/llm/test_pipeline.py checks every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is deleted once the next one is written, as are the tables that the stage made."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        with dropped_after(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            drop_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
