from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 30_000 + "end"
#: Nulls in any column, empty and very long texts, ties, repeated rows.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (4, LONG, "en", "a", len(LONG)),
    (5, "same text of five words here", "en", "b", 28),
    (6, "same text of five words here", "en", "b", 28),
    (6, "same text of five words here", "en", "b", 28),
    (7, "é", None, "b", 1),
    (8, "one two", "fr", None, 7),
    (9, "Ünïcödé 日本語 😀 text", "de", "c", 18),
    (None, "a row without an id", "en", "c", 19),
]
CLASHING = ["score", "size", "spans", "n_words", "run", "ahead", "gate", "found", "_row", "_shard", "taken", "key", "id", "label", "held_out", "root", "component_id"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(spark, odd):
    """The odd rows with more columns, whose names operators use themselves."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return documents.orderBy("doc_id").collect()
