"""Toxicity by a counterfactually regularised classifier.

A logistic model over words and word beginnings is fitted on labelled documents. In each labelled document that names a group,
its identity terms are swapped for others of the same kind; to each other one a mention of a group is added, drawn by a hash of
its words. The squared change of score is added to the loss, so that naming a group has no weight of its own, nor
has a beginning of a word that a group's name shares with words of toxic texts.

Learnt on a bounded sample of labelled rows outside the held-out fold (learning.BOUND); every whole text is scored.
Inputs of a score are words of the text alone.

Defined results: a null or empty text gets the score of a text without known words; without labels, or with labels
of one kind only, every score is that kind's share; equal texts have equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import emitted, held_out, rows, table, texts
from textloom.llm.learning import BOUND, labelled

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS, OFTEN = (3, 4, 5, 6, 7), (2, 4)
SHORTEST = BEGINNINGS[0]
#: Terms that stand for each other in a counterfactual.
IDENTITIES = (
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "black white asian latino african arab indian".split(),
    "gay lesbian straight bisexual queer heterosexual".split(),
    "transgender cisgender nonbinary".split(),
    "immigrants refugees natives foreigners".split(),
    "immigrant refugee native foreigner".split(),
    "disabled blind deaf paralyzed".split(),
    "elderly old young teenage".split(),
    "american mexican chinese russian german french".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden hindus buddhisten atheisten".split(),
    "schwarze weiße asiaten araber afrikaner".split(),
    "schwule lesben heteros bisexuelle".split(),
    "einwanderer flüchtlinge einheimische ausländer".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs hindous bouddhistes athées".split(),
    "noirs blancs asiatiques arabes africains".split(),
    "homosexuels lesbiennes hétérosexuels bisexuels".split(),
    "immigrés réfugiés étrangers autochtones".split(),
    "mujeres hombres niñas niños".split(),
    "musulmanes cristianos judíos hindúes budistas ateos".split(),
    "negros blancos asiáticos árabes africanos".split(),
    "homosexuales lesbianas heterosexuales bisexuales".split(),
    "inmigrantes refugiados extranjeros nativos".split(),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITIES for i, t in enumerate(g)}
#: Features kept: the most, and the least likelihood ratio (of the counts in either class) and log odds ratio.
MOST_FEATURES, SURE, LIFT = 500, 10.0, 2.5
RIDGE, FAIR = 0.3, 10.0


def features(words: Counter) -> set[str]:
    """Words, and beginnings of words with how often they occur."""
    out = set(words)
    for n in BEGINNINGS:
        begun: Counter = Counter()
        for w, k in words.items():
            if len(w) >= n:
                begun[w[:n]] += k
        for b, k in begun.items():
            out.add("^" + b)
            out.update([f"{o}^{b}" for o in OFTEN if k >= o])
    return out


def counted(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def swapped(words: Counter) -> Counter | None:
    """The words with identity terms replaced, or None if there are none."""
    if not any(t in words for t in SWAP):
        return None
    out: Counter = Counter()
    for w, k in words.items():
        out[SWAP.get(w, w)] += k
    return out


MENTIONS = tuple(SWAP)


def mentioned(words: Counter) -> Counter:
    """A mention of a group, the same for the same words."""
    return Counter([MENTIONS[crc32(" ".join(sorted(words)).encode("utf-8", "surrogatepass")) % len(MENTIONS)]])


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]
    starts: frozenset[str] = frozenset()

    def score(self, text: str) -> float:
        starts = self.starts
        words = counted(text)
        # no feature of any other word is known
        near = Counter({w: k for w, k in words.items() if w[:SHORTEST] in starts}) if starts else None
        total = self.bias
        if near:
            total += sum(self.weights.get(f, 0.0) for f in sorted(features(near)))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def hashed(name: str) -> int:
    """Signed, so that a sample's features take four bytes each."""
    return crc32(name.encode("utf-8", "surrogatepass")) - (1 << 31)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    """Lists of a column as views of its buffers."""
    out: list[np.ndarray | None] = []
    for c in column.chunks:
        values, at, null = c.values.to_numpy(), c.offsets.to_numpy(), c.is_null().to_numpy(zero_copy_only=False)
        out += [None if null[i] else values[at[i] : at[i + 1]] for i in range(len(c))]
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("label", pa.int32()), ("own", pa.list_(pa.int32())), ("other", pa.list_(pa.int32())), ("added", pa.list_(pa.int32()))])
    hashes = lambda words: sorted({hashed(f) for f in features(words)})

    def found() -> Iterator[tuple]:
        for b in batches:
            for label, text in rows(b, label=pa.int32(), text=pa.string()):
                words = counted(text)
                other = swapped(words)
                yield label, hashes(words), hashes(other) if other else None, None if other else hashes(mentioned(words))

    return emitted(schema, found(), 200)


def fit(y: np.ndarray, own: list[np.ndarray], other: list[np.ndarray | None], added: list[np.ndarray | None] = [], fair: float = FAIR) -> tuple[float, dict[int, float]]:  # noqa: B006
    """Bias, and weights by hash: ridge logistic regression by Newton steps over the surest features, with the counterfactual penalty.

    other: a text's features with its groups swapped; added: those of a mention added to it.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) == 0 or y.min() == y.max():
        return float(np.log(share / (1 - share))), {}
    # features of positives that occur more than once there, and how often they do elsewhere
    names, p = np.unique(np.concatenate([x for x, k in zip(own, y, strict=True) if k]), return_counts=True)
    names, p = names[p > 1], p[p > 1].astype(float)
    if not len(names):
        return float(np.log(share / (1 - share))), {}
    n = np.zeros(len(names))
    for x, k in zip(own, y, strict=True):
        if not k:
            at = np.minimum(np.searchsorted(names, x), len(names) - 1)
            n[at[names[at] == x]] += 1
    pos, neg = y.sum(), len(y) - y.sum()
    odds = np.log((p + 0.5) / (pos - p + 0.5)) - np.log((n + 0.5) / (neg - n + 0.5))
    term = lambda seen, of: seen * np.log(np.maximum(seen, 1e-9) / ((p + n) * of / len(y)))
    sure = 2 * (term(p, pos) + term(n, neg))
    kept = np.flatnonzero((sure >= SURE) & (odds >= LIFT))
    kept = np.sort(names[kept[np.lexsort((names[kept], -sure[kept]))][:MOST_FEATURES]])

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(kept) + 1), np.float32)
        x[:, -1] = 1
        for i, r in enumerate(rows):
            x[i, :-1] = np.isin(kept, r, assume_unique=True)
        return x

    x = matrix(own)
    pairs = [i for i, o in enumerate(other) if o is not None]
    changed = matrix([other[i] for i in pairs]) - x[pairs] if pairs else np.zeros((0, x.shape[1]), np.float32)
    more = [i for i, o in enumerate(added) if o is not None]
    if more:  # a feature that the text has already doesn't change
        changed = np.concatenate([changed, np.maximum(matrix([added[i] for i in more]) - x[more], 0)])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    fixed = np.diag(ridge) + 2 * fair * (changed.T @ changed)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    for _ in range(12):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None].astype(np.float32)) + fixed, x.T @ (y - q) - fixed @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return float(w[-1]), dict(zip(kept.tolist(), w[:-1].tolist(), strict=True))


def learn(docs: DataFrame, labels: DataFrame, bound: int = BOUND, fair: float = FAIR) -> Model:
    sample = labelled(texts(docs), labels, "toxic", bound)
    got = sample.select("label", "text").mapInArrow(_extract, "label int, own array<int>, other array<int>, added array<int>").toArrow()
    bias, weights = fit(np.array(got.column("label").to_pylist(), float), _arrays(got.column("own")), _arrays(got.column("other")), _arrays(got.column("added")), fair)
    if not weights:
        return Model(bias, {})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The names of the hashes that have a weight: a second pass over the sample, which sends at most those back."""
        seen: set[str] = set()
        for b in batches:
            for (text,) in rows(b, text=pa.string()):
                seen.update(f for f in features(counted(text)) if hashed(f) in weights)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["name"])

    names = [r.name for r in sample.select("text").mapInArrow(named, "name string").distinct().collect()]
    return Model(bias, {n: weights[hashed(n)] for n in names}, frozenset(n.lstrip("0123456789").lstrip("^")[:SHORTEST] for n in names))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; no shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
        return emitted(schema, ((i, h, model.score(t)) for b in batches for i, h, t in rows(b, doc_id=pa.int64(), held_out=pa.bool_(), text=pa.string())))

    out = texts(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(each, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, columns as they are, whose text the model doesn't call toxic."""

    @F.pandas_udf("double")
    def scored(text):  # noqa: ANN001, ANN202
        return text.fillna("").map(model.score)

    return docs.where(scored(F.col("text").cast("string")) < 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
