"""Quality by positive-unlabelled learning.

An additive model over binned statistics of a text minimises the non-negative unbiased risk under squared loss. Trusted
positives are documents labelled 1; documents labelled 0 are never told from unlabelled ones. Under squared loss the risk
depends on the texts only by how often each pair of bins occurs together, so that all documents outside the held-out fold
count as unlabelled, by one aggregation, and the driver holds tables of a size fixed by the number of bins.

Statistics are measured once for each document, rounded to steps of below 1 % that keep their order, and written; what
follows reads these narrow rows: exact counts of steps (quantiles: borders of bins), counts of pairs of bins, and a histogram of scores.

The class prior comes from positives and unlabelled rows too: a classifier of the one against the other is fitted with half
of the positives; above each threshold, the share of unlabelled rows over the share of the other positives is, within
its confidence bound, at least the prior, and the threshold of the least bound gives it (best bin estimation). Where the risk
of negatives falls below 0, a step is taken against it. A slope and an offset that minimise the unbiased logistic risk over the
histogram put the sums on the scale of probabilities.

At most learning.BOUND labelled rows are taken. Inputs of a score are statistics of the text alone.

Defined results: a null or empty text is scored as any other; without trusted positives, or without unlabelled rows, every score is 0.5; equal
texts have equal scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import held_out, table, texts, written
from textloom.llm.learning import BOUND, known

BINS, STEPS, RATE, L2, PRIOR_ROWS = 25, 400, 0.01, 1e-3, 50.0
#: Classes of a histogram of sums between -SPAN and SPAN, and rows whose pairs of bins are counted at once.
CLASSES, SPAN, AT_ONCE = 1000, 3.0, 8192
#: Kinds of rows in counts: unlabelled, and positives in two halves.
UNLABELLED, FIRST, SECOND = 0, 1, 2


def _bytes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


_LOWER, _UPPER, _DIGIT = _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
_STOP, _MARK, _BAR = _bytes(".,;:?'\"-()"), _bytes("#$%&*@^~<>{}[]\\/=+_`"), _bytes("|")


def statistics(text: bytes) -> list[float]:
    """Shares of kinds of bytes, and how words and lines are spread and repeated."""
    n = max(1, len(text))
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda chars: float(kinds[chars].sum()) / n
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / k
    lower, upper = share(_LOWER), share(_UPPER)
    packed = len(zlib.compress(text, 1)) / n
    return [
        float(np.log1p(len(text))),
        lower,
        upper / max(1e-9, lower + upper),
        share(_DIGIT),
        share(_STOP),
        share(_MARK),
        share(_BAR),
        float(kinds[33]) / n,
        float(kinds[128:].sum()) / n,
        float(kinds[10]) / n,
        len(text) / k,
        len(counts) / k**0.9,
        again,
        counts.most_common(1)[0][1] / k if counts else 0.0,
        len(set(lines)) / max(1, len(lines)),
        packed,
        packed * float(np.log1p(len(text))),
    ]


def steps(x: np.ndarray) -> np.ndarray:
    """Upper half of the 32 bits of a float: for values from 0 on, integers in the values' order, below 1 % apart."""
    return (np.maximum(x, 0).astype("<f4").view("<u4") >> 16).astype(np.int16)


class Model(NamedTuple):
    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def risen(self, x: np.ndarray) -> np.ndarray:
        """The sum of weights for each row of steps."""
        total = np.full(len(x), self.bias)
        for j, e in enumerate(self.edges):
            total += self.weights[j, np.searchsorted(e, x[:, j], side="right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.risen(x) + self.offset, -40, 40)))


class Moments(NamedTuple):
    """Number of rows, and how many have both of two bins (flat numbers feature * BINS + bin)."""

    rows: float
    pairs: np.ndarray

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        """Means of the features' products and of the features, the last one constant."""
        n = max(1.0, self.rows)
        one = np.append(np.diag(self.pairs), self.rows)[:, None] / n
        return np.block([[self.pairs / n, one[:-1]], [one.T]]), one[:, 0]


def cells(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") + j * BINS for j, e in enumerate(edges)], 1)


def moments(x: np.ndarray, edges: list[np.ndarray]) -> Moments:
    width = len(edges) * BINS
    pairs = np.zeros(width * width)
    for i in range(0, len(x), AT_ONCE):
        c = cells(x[i : i + AT_ONCE], edges)
        pairs += np.bincount((c[:, :, None] * width + c[:, None, :]).ravel(), minlength=width * width)
    return Moments(float(len(x)), pairs.reshape(width, width))


def together(*parts: Moments) -> Moments:
    return Moments(sum(m.rows for m in parts), sum(m.pairs for m in parts))


def fit(positive: Moments, unlabelled: Moments, edges: list[np.ndarray], prior: float) -> Model:
    """Non-negative unbiased risk with squared loss: the unbiased risk's minimum, then, where the risk of negatives is
    below 0 there, steps that go against it while it is, and on otherwise."""
    (gp, mp), (gu, mu) = positive.means(), unlabelled.means()
    # a prior on weights, worth as much as so many rows: few rows bear few weights
    keep = (L2 + PRIOR_ROWS / max(1.0, positive.rows)) * np.eye(len(mp))
    keep[-1, -1] = 1e-9
    w = np.linalg.solve(gu + keep, 2 * prior * mp - mu)
    rest = lambda w: w @ gu @ w + 2 * mu @ w + 1 - prior * (w @ gp @ w + 2 * mp @ w + 1)
    own = lambda w: prior * (w @ gp @ w - 2 * mp @ w + 1)
    risk = lambda w: own(w) + max(0.0, rest(w)) + w @ keep @ w
    best, least = w, risk(w)
    if rest(w) < 0:
        m, v = np.zeros(len(w)), np.zeros(len(w))
        for step in range(1, STEPS + 1):
            below = 2 * (gu @ w + mu - prior * (gp @ w + mp))
            g = -below if rest(w) < 0 else 2 * prior * (gp @ w - mp) + below
            g = g + 2 * keep @ w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            if risk(w) < least:
                best, least = w, risk(w)
    return Model(edges, best[:-1].reshape(len(edges), BINS), float(best[-1]))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, more: float = 0.01) -> float:
    """The prior from histograms of scores of positives not fitted on and of unlabelled rows, classes from low to high."""
    n, k = positive.sum(), unlabelled.sum()
    if not n or not k:
        return 0.5
    p, u = positive[::-1].cumsum() / n, unlabelled[::-1].cumsum() / k
    some = p > 0
    p, u = p[some], u[some]
    error = np.sqrt(np.log(4 / delta) / (2 * n)) + np.sqrt(np.log(4 / delta) / (2 * k))
    at = int(np.argmin((u + (1 + more) * error) / p))
    return float(np.clip(u[at] / p[at], 0.01, 0.99))


def scaled(model: Model, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """With the slope and offset that minimise the unbiased logistic risk, E_u log(1 + exp z) - prior * E_p z."""
    z = np.stack([(np.arange(CLASSES) + 0.5) * (2 * SPAN / CLASSES) - SPAN, np.ones(CLASSES)], 1)
    u, aim = unlabelled / unlabelled.sum(), prior * (positive / positive.sum()) @ z
    w, keep = np.array([2.0, 0.0]), np.diag([L2, 1e-9])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (u * q * (1 - q) + 1e-9)[:, None]) + keep, aim - (u * q) @ z - keep @ w)
        w = w + np.clip(step, -0.5, 0.5)
    return model._replace(slope=max(0.0, float(w[0])), offset=float(w[1]))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, x (steps of its text's statistics) of each document; no shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [steps(np.array(statistics(t))) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(x, pa.list_(pa.int16()))], ["doc_id", "held_out", "x"])

    found = texts(docs).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return found.mapInArrow(each, "doc_id long, held_out boolean, x array<smallint>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, len(statistics(b""))), np.int16)


def _borders(rows: DataFrame) -> list[np.ndarray]:
    """Quantiles of each statistic over all rows, from exact counts of its steps."""
    columns = len(statistics(b""))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(columns << 15, np.int64)
        for b in batches:
            seen += np.bincount((_matrix(b.column("x")) + (np.arange(columns) << 15)).ravel(), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["at", "n"])

    got = rows.select("x").mapInArrow(each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
    edges = []
    for j in range(columns):
        mine = np.flatnonzero(at >> 15 == j)
        mine = mine[at[mine].argsort()]
        total = n[mine].cumsum()
        wanted = np.arange(1, BINS) * (total[-1] / BINS) if len(total) else np.zeros(0)
        edges.append(np.unique(at[mine][np.searchsorted(total, wanted)] - (j << 15)))
    return edges


def _moments(rows: DataFrame, edges: list[np.ndarray]) -> list[Moments]:
    """Moments of rows (kind, x) for each kind; a positive is an unlabelled row too."""
    width = len(edges) * BINS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Moments(0.0, np.zeros((width, width))) for _ in range(3)]
        for b in batches:
            kind, x = b.column("kind").to_numpy(zero_copy_only=False), _matrix(b.column("x"))
            for k in range(3):
                own = x if k == UNLABELLED else x[kind == k]
                if len(own):
                    seen[k] = together(seen[k], moments(own, edges))
        for k in range(3):
            at = np.flatnonzero(np.triu(seen[k].pairs))
            # the number of rows has a place of its own
            n = np.append(seen[k].pairs.ravel()[at], seen[k].rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, width * width) * 3 + k, pa.int64()), pa.array(n, pa.int64())], ["at", "n"])

    got = rows.select("kind", "x").mapInArrow(each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
    out = []
    for k in range(3):
        flat = np.zeros(width * width + 1)
        flat[at[at % 3 == k] // 3] = n[at % 3 == k]
        upper = flat[:-1].reshape(width, width)
        out.append(Moments(float(flat[-1]), upper + np.triu(upper, 1).T))
    return out


def _histograms(rows: DataFrame, models: list[Model]) -> np.ndarray:
    """Counts by model, kind and class of the sum, of rows (kind, x)."""
    shape = (len(models), 3, CLASSES)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shape, np.int64)
        for b in batches:
            kind, x = b.column("kind").to_numpy(zero_copy_only=False), _matrix(b.column("x"))
            for i, m in enumerate(models):
                at = np.clip((m.risen(x) + SPAN) / (2 * SPAN) * CLASSES, 0, CLASSES - 1).astype(int)
                seen[i, UNLABELLED] += np.bincount(at, minlength=CLASSES)
                for k in (FIRST, SECOND):
                    seen[i, k] += np.bincount(at[kind == k], minlength=CLASSES)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen.ravel()[at], pa.int64())], ["at", "n"])

    got = rows.select("kind", "x").mapInArrow(each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(shape)
    out.ravel()[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def learn(rows: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """From rows of measured(), best as a table: they are read three or four times."""
    half = F.when(F.xxhash64(F.lit("half"), "doc_id") % 2 == 0, FIRST).otherwise(SECOND)
    positive = known(labels, "quality", bound).where("label = 1").select(F.col("doc_id").cast("long"), half.alias("kind"))
    rows = rows.where(~F.col("held_out")).select("doc_id", "x").join(F.broadcast(positive), "doc_id", "left")
    rows = rows.select(F.coalesce("kind", F.lit(UNLABELLED)).alias("kind"), "x")
    edges = _borders(rows)
    everything, first, second = _moments(rows, edges)
    positives = together(first, second)
    if not positives.rows or everything.rows == positives.rows:
        return Model(edges, np.zeros((len(edges), BINS)), 0.0)
    # positives of the first half against unlabelled rows, as classes of equal weight
    prior = class_prior(*_histograms(rows, [fit(first, everything, edges, 0.5)])[0, [SECOND, UNLABELLED]])
    model = fit(positives, everything, edges, prior)
    seen = _histograms(rows, [model])[0]
    return scaled(model, seen[FIRST] + seen[SECOND], seen[UNLABELLED], prior)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of measured(); no shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    out = rows.select("doc_id", "held_out", "x").mapInArrow(each, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(measured(table(spark, sf_dir, "documents")), "quality")
    return score(rows, learn(rows, table(spark, sf_dir, "labels")))
