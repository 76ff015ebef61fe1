"""A corpus prepared for training in five stages, each written as Parquet and read again before the next.

toxicity: documents that the classifier calls toxic go. near duplicates: one document of each group stays (word
5-shingles, similarity 0.8). secrets: what the scan reports is replaced in the text. mixing: documents are taken as
often as their source's share says: whole copies as rows, the last in part as a row with the text's first words. packing:
what is left becomes pieces of training sequences.

Every stage but the last returns the columns of its input, and works on all rows that the one before kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import mixing, near_duplicates, packing, secrets, toxicity
from textloom.llm.common import prepare, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not called toxic. The model learns from the labelled rows of the documents that this stage is given."""
    prepare(spark)
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("near_duplicates", deduplicated),
    ("secrets", redacted),
    ("mixing", mixed),
    ("packing", packed),
]

#: Classifier, likelihood filter, compressor, apportionment and tokenizer aren't SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        schema = out.schema
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(schema).parquet(f"{base}/{name}")
    return docs
