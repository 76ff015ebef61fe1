"""Samples of labelled rows for the classifiers.

A classifier takes at most `bound` labelled rows (a parameter; those of smallest seeded hash of doc_id), which every size of
input has in the same way. Nothing else is sampled: unlabelled documents count all, and all documents are scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import held_out

BOUND, SEED = 12_000, 11


def known(labels: DataFrame, column: str, bound: int = BOUND) -> DataFrame:
    """doc_id, label of sampled labelled ids outside the held-out fold. A doc_id labelled twice counts as 1 if either does."""
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(bound)


def labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int = BOUND) -> DataFrame:
    """doc_id, text, label of the documents of known()."""
    return docs.join(F.broadcast(known(labels, column, bound)), "doc_id").select("doc_id", "text", "label")
