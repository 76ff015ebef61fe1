"""Scores of matched documents, and what raises or lowers them.

A document is one row with the frequencies of all query terms in one array, so that a score is an expression over that row and
one row of statistics (documents searched, mean length, and document frequencies in the order of the terms). The statistics
are one aggregation of one scan; nothing is shuffled by document.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.languages import STOPWORDS
from textloom.functions.lexical import marks
from textloom.functions.matching import literal_spans, spans_of
from textloom.operators.postings import words
from textloom.query.nodes import Node
from textloom.session import prepare

#: The constants of the scores.
DEFAULT_SCORE, LOCATION, DEPTH, STOPWORD = 0.01, 0.15, 0.02, 0.1
EXACT_NAME, PART_OF_NAME, FOLDER_NAME, TEST_INTENT = 1.0, 0.6, 0.6, 1.5
INTENT_WORDS = frozenset("test assert expect mock stub bench suite spec should".split())
GRAVITY = {"off": 0.0, "low": 0.2, "default": 1.0, "logic": 1.5, "brain": 2.5}
NOISE = {"silence": 0.1, "quiet": 0.5, "default": 1.0, "loud": 2.0, "raw": 100.0}
WEIGHED = "struct<tf:array<double>,present:array<boolean>,gaps:array<struct<a:int,b:int,gap:int>>>"


@dataclass(frozen=True)
class Profile:
    k1: float = 1.2
    b: float = 0.75
    gravity: float = 1.0
    noise: float = 1.0
    test_penalty: float = 0.4
    length_bias: float = 0.0


PROFILES = {
    "balanced": Profile(),
    "precise": Profile(0.3, 0.95, 2.5, 2.5, 0.1, 0.3),
    "broad": Profile(2.5, 0.15, 0.3, 0.3, 1.0, -0.1),
}


def profile(name: str | None = None, gravity: str | None = None, noise: str | None = None) -> Profile:
    """A named profile, or the default one with strengths given by name."""
    if name in PROFILES:
        return PROFILES[name]
    p = Profile()
    if gravity:
        p = replace(p, gravity=GRAVITY.get(gravity, 1.0))
    return replace(p, noise=NOISE.get(noise, 1.0)) if noise else p


@dataclass(frozen=True)
class Weights:
    """What a match counts by the class it stands in; the rest is left out if `only` names a class."""

    code: float = 1.0
    comment: float = 0.2
    string: float = 0.5
    only: str | None = None

    def by_class(self) -> dict[str, float]:
        w = {"code": self.code, "comment": self.comment, "string": self.string}
        return {k: v if k == self.only else 0.0 for k, v in w.items()} if self.only else w

    def of(self, cls: Column) -> Column:
        w = self.by_class()
        return F.when(cls == "comment", w["comment"]).when(cls == "string", w["string"]).otherwise(w["code"])


@dataclass(frozen=True)
class MinimumProfile:
    k1: float = 1.2
    b: float = 0.75
    proximity: float = 1.5
    blend: float = 0.1
    declaration: float = 3.0
    weights: Weights = Weights(1.0, 0.3, 0.5)


def statistics(rows: DataFrame, docs: DataFrame, terms: int, scanned: int | None = None) -> DataFrame:
    """One row: scanned (all documents searched), avg_words of those that matched, df of each term among them.

    rows: bytes, present (array of whether each term stands there). scanned, where it is known, is not counted.
    """
    df = [F.coalesce(F.sum(F.get("present", F.lit(i)).cast("long")), F.lit(0)) for i in range(terms)]
    own = rows.agg(F.coalesce(F.avg(words()), F.lit(1.0)).alias("avg_words"), F.array(*df).cast("array<bigint>").alias("df"))
    if scanned is not None:
        return own.withColumn("scanned", F.lit(scanned).cast("long"))
    return docs.agg(F.count("*").alias("scanned")).crossJoin(F.broadcast(own))


def with_statistics(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows with the one row of statistics, and words."""
    return rows.crossJoin(F.broadcast(stats)).withColumn("words", words())


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def _seen(df: Column) -> Column:
    return F.greatest(F.lit(1), df).cast("double")


def tfidf(classic: bool = False) -> Column:
    """Term frequency times inverse document frequency; in the newer form its root, tempered by length."""

    def one(tf: Column, df: Column) -> Column:
        rate, idf = tf / F.col("words"), F.log10(F.col("scanned") / _seen(df))
        return rate * idf if classic else F.sqrt(rate) * idf / F.sqrt(F.col("words").cast("double"))

    return _sum(F.zip_with("tf", "df", one))


def _saturated(tf: Column, df: Column, k1: float, b: float) -> Column:
    idf = F.log10(1 + F.col("scanned") / _seen(df))
    length = k1 * (1 - b + b * F.col("words") / F.col("avg_words"))
    return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + length)).otherwise(0.0)


def bm25(k1: float = 1.2, b: float = 0.75) -> Column:
    return _sum(F.zip_with("tf", "df", lambda tf, df: _saturated(tf, df, k1, b)))


def structural(terms: list[str], p: Profile = Profile()) -> Column:
    """bm25 over weighted frequencies, common words of the document's language dampened unless all its terms are such."""
    common = F.array(*[_stopword(t) for t in terms])
    all_common = F.forall(F.zip_with("present", common, lambda here, c: ~here | c), lambda x: x)
    damp = F.transform(common, lambda c: F.when(c & ~all_common, STOPWORD).otherwise(1.0))
    ones = F.zip_with("tf", "df", lambda tf, df: _saturated(tf, df, p.k1, p.b))
    return _sum(F.zip_with(ones, damp, lambda x, d: x * d))


def _stopword(term: str) -> Column:
    languages = sorted(k for k, known in STOPWORDS.items() if term.lower() in known)
    return F.col("language").isin(*languages) if languages else F.lit(False)


def minimum(p: MinimumProfile = MinimumProfile()) -> Column:
    """The weakest pair of terms, raised by how near they come, blended with the mean over terms.

    rows hold gaps: array of (a, b, gap) for each pair of terms that stand there, by their numbers.
    """
    ones = F.zip_with("tf", "df", lambda tf, df: _saturated(tf, df, p.k1, p.b))
    n = F.size(F.filter("present", lambda x: x))
    pair = lambda x: F.least(F.get(ones, x["a"]), F.get(ones, x["b"])) * (1 + p.proximity / (x["gap"] / 6 + 1))
    weakest = F.array_min(F.transform("gaps", pair))
    blended = (1 - p.blend) * weakest + p.blend * _sum(ones) / F.greatest(n, F.lit(1))
    return F.when(n <= 1, _sum(ones)).otherwise(blended)


def gaps_of(spans: list, terms: list[str]) -> list[dict]:
    """For each pair of terms that stand there, the least distance in bytes between places of one and the other."""
    at: dict[int, list[tuple[int, int]]] = {}
    number = {t: i for i, t in enumerate(terms)}
    for x in spans:
        at.setdefault(number[x["term"]], []).append((x["s"], x["e"]))
    return gaps_between(at)


def gaps_between(at: dict[int, list[tuple[int, int]]]) -> list[dict]:
    """gaps_of places by the number of their term."""
    out = []
    for a in sorted(at):
        for b in sorted(k for k in at if k > a):
            # in order of place, the nearest before of the other term is the one that reaches furthest
            reach, best = {a: None, b: None}, None
            for s, e, own in sorted([(*x, a) for x in at[a]] + [(*x, b) for x in at[b]]):
                other = reach[b if own == a else a]
                if other is not None and (best is None or s - other < best):
                    best = s - other
                reach[own] = e if reach[own] is None else max(reach[own], e)
            out.append({"a": a, "b": b, "gap": max(0, best)})
    return out


def weighed_of(text: str, language: str, nodes: list[Node], whole: str | None, weights: Weights, raised: float, sensitive: bool, near: bool) -> tuple[list, list, list]:
    """What weighed() has of one text."""
    by = weights.by_class()
    at = [spans_of(text, n, sensitive) for n in nodes] + ([literal_spans(text, whole, False)] if whole else [])
    found = marks(text.encode("utf-8", "surrogatepass"), language, (s for places in at for s, _ in places))
    tf = []
    for places in at:
        total = 0.0
        for cls, _, on_declaration in islice(found, len(places)):
            total += by.get(cls, by["code"]) * (raised if on_declaration else 1.0)
        tf.append(total)
    return tf, [bool(places) for places in at], gaps_between({i: places for i, places in enumerate(at) if places}) if near else []


def weighed(text: Column, language: Column, nodes: list[Node], whole: str | None, weights: Weights, raised: float = 1.0, sensitive: bool = False, near: bool = False) -> Column:
    """Weighted frequencies, presence and (if near) gaps of the terms, last of a whole query: the places of one text at a time
    are in memory, and none leaves Python. Empty for a null text."""
    prepare()

    @F.pandas_udf(WEIGHED)
    def found(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
        rows = [([], [], []) if t is None else weighed_of(t, k, nodes, whole, weights, raised, sensitive, near) for t, k in zip(texts, languages, strict=True)]
        return pd.DataFrame(rows, columns=["tf", "present", "gaps"], dtype=object)

    return found(text, language)


def gaps(locations: Column, terms: list[str]) -> Column:
    prepare()
    @F.pandas_udf("array<struct<a:int,b:int,gap:int>>")
    def found(spans: pd.Series) -> pd.Series:
        return pd.Series([gaps_of(list(x), terms) for x in spans], dtype=object)

    return found(locations)


def location(score: Column, path: Column, terms: Column) -> Column:
    """Raised by each term that stands in the path, the more the nearer to its start."""
    low = F.lower(path)

    def step(acc: Column, term: Column) -> Column:
        t = F.lower(term)
        n = (F.octet_length(low) - F.octet_length(F.replace(low, t, F.lit("")))) / F.octet_length(t)
        first = F.octet_length(F.substring(low, F.lit(1), F.position(t, low) - 1))
        was = F.when((acc["score"] == 0) | F.isnan(acc["score"]), DEFAULT_SCORE).otherwise(acc["score"])
        now = was * (1 + LOCATION * n * F.octet_length(term)) / (1 + first * DEPTH)
        inside = (F.octet_length(t) > 0) & F.contains(low, t)
        return F.struct(F.when(inside, now).otherwise(acc["score"]).alias("score"), (acc["found"] + inside.cast("int")).alias("found"))

    start = F.struct(score.cast("double").alias("score"), F.lit(0).alias("found"))
    return F.aggregate(terms, start, step, lambda acc: acc["score"] * F.when(acc["found"] > 1, 1 + LOCATION * acc["found"]).otherwise(1.0))


def gravity(score: Column, complexity: Column, strength: float) -> Column:
    return score if strength == 0 else score * (1 + F.log1p(complexity.cast("double")) * strength)


def noise(score: Column, complexity: Column, bytes_: Column, sensitivity: float) -> Column:
    if sensitivity >= 100:
        return score
    return score * F.least(F.lit(1.0), (complexity + 1) / F.log10(F.greatest(F.lit(10.0), bytes_.cast("double"))) * sensitivity)


def length_bias(score: Column, bytes_: Column, bias: float) -> Column:
    return score if bias == 0 else score / (1 + bias * F.log10(F.greatest(F.lit(10.0), bytes_.cast("double"))))


def is_test_file(path: Column) -> Column:
    """By folder (test, tests, __tests__ below another), or by a name that begins or ends in what marks tests."""
    return F.lower(path).rlike(r"/(?:tests?|__tests__)/|(?:^|/)test_[^/]*$|(?:_test\.|\.test\.|\.spec\.)[^/]*$|tests?\.[^./]*$|(?:^|/)[^./]*tests?$")


def has_test_intent(query: str) -> bool:
    return any(w.lower() in INTENT_WORDS for w in query.split())


def test_dampening(score: Column, path: Column, penalty: float, intent: bool) -> Column:
    if penalty == 1 and not intent:
        return score
    return F.when(is_test_file(path), score * (TEST_INTENT if intent else penalty)).otherwise(score)


def filename_boost(score: Column, path: Column, terms: Column) -> Column:
    """Raised where terms are the file's name without extension, part of it, or its folder's name."""
    parts = F.split(F.lower(path), "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    # a file without a folder stands in "."
    folder = F.when(F.size(parts) > 1, F.coalesce(F.when(F.get(parts, F.size(parts) - 2) == "", "/").otherwise(F.get(parts, F.size(parts) - 2)), F.lit("."))).otherwise(F.lit("."))

    def step(acc: Column, term: Column) -> Column:
        t = F.lower(term)
        by_name = F.when(name == t, EXACT_NAME).when(F.contains(name, t), PART_OF_NAME).otherwise(0.0)
        by_folder = F.when(folder == t, FOLDER_NAME).otherwise(0.0)
        return F.struct((acc["boost"] + by_name + by_folder).alias("boost"), (acc["n"] + (by_name > 0).cast("int") + (by_folder > 0).cast("int")).alias("n"))

    start = F.struct(F.lit(0.0).alias("boost"), F.lit(0).alias("n"))
    return F.aggregate(terms, start, step, lambda acc: score * (1 + acc["boost"] * acc["n"] / F.greatest(F.lit(1), F.size(terms))))


def modified(df: DataFrame, p: Profile = Profile(), intent: bool = False, ranker: str = "structural") -> DataFrame:
    """df with its score modified, in order, from path, terms, complexity and bytes."""
    steps = [
        lambda s: s if ranker == "simple" else location(s, F.col("path"), F.col("terms")),
        lambda s: gravity(s, F.col("complexity"), p.gravity),
        lambda s: noise(s, F.col("complexity"), F.col("bytes"), p.noise),
        lambda s: length_bias(s, F.col("bytes"), p.length_bias),
        lambda s: test_dampening(s, F.col("path"), p.test_penalty, intent),
        lambda s: filename_boost(s, F.col("path"), F.col("terms")),
    ]
    for step in steps:
        df = df.withColumn("score", step(F.col("score")))
    return df
