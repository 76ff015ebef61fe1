"""Matches as relations: term frequencies and spans, and the statistics that rankers need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.matching import SPANS, locate, occurrences, phrase_term, term_of
from textloom.query.nodes import Keyword, Node

#: Fixed value: bytes of a word, as rankers estimate it.
WORD_BYTES = 2


def words(bytes_: str = "bytes") -> Column:
    """A document's length in words."""
    return F.expr(f"greatest(1, {bytes_} div {WORD_BYTES})").cast("long")


def distinct_nodes(nodes: list[Node]) -> list[Node]:
    return list({term_of(n): n for n in nodes}.values())


def term_frequencies(hits: DataFrame, nodes: list[Node], sensitive: bool = False, query: str | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys, term, tf of the terms that stand in each document: one projection, without a join or a list of places.

    Terms that built-in functions can't count are counted by their places.
    """
    nodes = distinct_nodes(nodes)
    counts, placed = [], []
    for n in nodes:
        count = occurrences(F.col("content"), n, sensitive)
        (placed.append(n) if count is None else counts.append((term_of(n), count)))
    if query and (whole := phrase_term(query)):
        counts.append((query, occurrences(F.col("content"), Keyword(whole), False)))
    parts = [F.struct(F.lit(t).alias("term"), c.cast("long").alias("tf")) for t, c in counts]
    out = hits.select(*keys, F.inline(F.array(*parts))) if parts else None
    if placed:
        spans = hits.select(*keys, F.inline(locate(F.col("content"), placed, sensitive)))
        more = spans.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
        out = more if out is None else out.unionByName(more)
    if out is None:
        out = hits.select(*keys, F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")).limit(0)
    return out.where("tf > 0")


def countable(nodes: list[Node]) -> bool:
    """Whether built-in functions can count all terms."""
    return all(occurrences(F.col("content"), n) is not None for n in nodes)


def frequencies(nodes: list[Node], names: list[str], query: str, whole: str | None, sensitive: bool) -> list[Column]:
    """How often each named term stands in the content, by built-in functions."""
    by = {term_of(n): n for n in nodes}
    return [occurrences(F.col("content"), by[t], sensitive) if t in by else occurrences(F.col("content"), Keyword(whole), False) for t in names]


def placed(locations: Column, term: str) -> Column:
    return F.size(F.filter(locations, lambda x: x["term"] == term))


def weighted(noted: Column, term: str, weight: Callable[[Column], Column], raised: float = 1.0) -> Column:
    """The weights of a term's places added up; places on a line that declares something count more."""
    one = lambda x: F.when(x["term"] == term, weight(x["cls"]) * F.when(x["on_declaration"], raised).otherwise(1.0)).otherwise(0.0)
    return F.aggregate(noted, F.lit(0.0), lambda acc, x: acc + one(x))


def located(hits: DataFrame, nodes: list[Node], sensitive: bool = False, query: str | None = None) -> DataFrame:
    """hits with match_locations: every place of every positive term, in bytes of the content."""
    nodes = distinct_nodes(nodes)
    if not nodes:
        return hits.withColumn("match_locations", F.expr(f"cast(array() as {SPANS})"))
    return hits.withColumn("match_locations", locate(F.col("content"), nodes, sensitive, query))


def spans(hits: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys, pos and the fields of each match location."""
    return hits.select(*keys, F.posexplode("match_locations").alias("pos", "at")).select(*keys, "pos", "at.*")


def document_frequency(postings: DataFrame) -> DataFrame:
    """term, df: in how many documents a term stands. As many rows as the query has terms."""
    return postings.groupBy("term").agg(F.countDistinct("path").alias("df"))


def corpus_frequency(postings: DataFrame) -> DataFrame:
    """term, ctf: how often a term stands in all documents."""
    return postings.groupBy("term").agg(F.sum("tf").cast("long").alias("ctf"))


def average_words(hits: DataFrame) -> DataFrame:
    """One row: the mean length in words of the documents that matched."""
    return hits.agg(F.avg(words()).alias("avg_words"))
