from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality as q
from textloom.llm import toxicity as t
from textloom.llm.common import held_out
from textloom.llm.learning import labelled

LABELS = "doc_id bigint, quality int, toxic int"


def fold(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def auc(score: np.ndarray, y: np.ndarray) -> float:
    rank = score.argsort().argsort() + 1
    p, n = y.sum(), (1 - y).sum()
    return float((rank[y == 1].sum() - p * (p + 1) / 2) / (p * n))


def test_folds(spark):
    got = {r.id: r.h for r in spark.range(200).select("id", held_out("id").alias("h")).collect()}
    assert got == {i: fold(i) for i in range(200)}
    assert spark.sql("select cast(null as bigint) x").select(held_out("x")).first()[0] is False


def test_samples_are_bounded_and_leave_out_the_fold(documents, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ids = [r.doc_id for r in labelled(documents, labels, "toxic", 20).collect()]
    assert len(ids) == 20 and not any(map(fold, ids))
    assert ids == [r.doc_id for r in labelled(documents, labels, "toxic", 20).collect()]


@pytest.fixture(scope="module")
def written_corpus(spark):
    """Documents that are clean, toxic or junk, and labels for them."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, rng.integers(20, 120)))
        toxic, junk = int(rng.random() < 0.2), int(rng.random() < 0.25)
        if toxic:
            for w in rng.choice(["scumbag", "moronic", "filthpig"], 3):
                text.insert(int(rng.integers(0, len(text))), str(w))
        if rng.random() < 0.3:
            text.insert(0, str(rng.choice(["women", "muslims", "gay"])))
        text = [w.upper() + "!!" for w in text] if junk else text
        docs.append((i, " ".join(text).capitalize() + "."))
        labels.append((i, 1 - junk, toxic))
    return spark.createDataFrame(docs, "doc_id bigint, text string").cache(), spark.createDataFrame(labels, LABELS).cache()


def test_toxicity_on_the_held_out_fold(written_corpus):
    docs, labels = written_corpus
    model = t.learn(docs, labels)
    p = t.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(p.score.to_numpy(), p.toxic.to_numpy()) > 0.97 and (p.predicted == p.toxic).mean() > 0.95
    assert ((p.score >= 0.5) == (p.predicted == 1)).all()
    left = t.clean(docs, model)
    assert left.columns == docs.columns and left.count() == t.score(docs, model).where("predicted = 0").count()


def test_identity_terms_cost_nothing():
    """Groups named more often in toxic texts: the penalty takes their weight away."""
    rng = np.random.default_rng(2)
    y, texts = [], []
    for _ in range(800):
        toxic = rng.random() < 0.3
        text = [*rng.choice(list("abcdefgh"), 5)]
        if toxic:
            text += ["vile"] if rng.random() < 0.8 else []
        text += ["muslims"] if rng.random() < (0.5 if toxic else 0.02) else []
        y.append(float(toxic))
        texts.append(" ".join(text))
    own = [np.array(sorted({t.hashed(f) for f in t.features(t.counted(x))}), np.int32) for x in texts]
    other = [None if (c := t.swapped(t.counted(x))) is None else np.array(sorted({t.hashed(f) for f in t.features(c)}), np.int32) for x in texts]
    _, fair = t.fit(np.array(y), own, other)
    _, plain = t.fit(np.array(y), own, [None] * len(own))
    weight = lambda w: sum(w.get(t.hashed(f), 0.0) for f in t.features(Counter({"muslims": 1})))
    assert weight(plain) > 1 and abs(weight(fair)) < 0.3 * weight(plain)
    assert fair[t.hashed("vile")] > 0.5


def test_swaps():
    assert t.swapped(Counter("the women here".split())) == Counter("the men here".split())
    assert t.swapped(Counter(["nobody"])) is None


def test_quality_on_the_held_out_fold(written_corpus):
    docs, labels = written_corpus
    measured = q.measured(docs).cache()
    p = q.score(measured, q.learn(measured, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(p.score.to_numpy(), p.quality.to_numpy()) > 0.97 and (p.predicted == p.quality).mean() > 0.93
    assert ((p.score >= 0.3) == (p.predicted == 1)).all()


def test_quality_learns_nothing_from_negatives(written_corpus):
    """Labels 0 may go: the same scores."""
    docs, labels = written_corpus
    measured = q.measured(docs).cache()
    one, other = (sorted(map(tuple, q.score(measured, q.learn(measured, k)).collect())) for k in (labels, labels.where("quality = 1")))
    assert one == other


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.sort(x[:, j])[np.ceil(np.arange(1, q.BINS) * len(x) / q.BINS).astype(int) - 1]) for j in range(x.shape[1])]


def test_counts_of_all_unlabelled_rows(documents, spark, sf):
    """Borders, pairs of bins and histograms against numpy over every document outside the fold."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = q.learn(q.measured(documents), labels)
    rows = [r for r in documents.collect() if not fold(r.doc_id)]
    x = np.stack([q.steps(np.array(q.statistics((r.text or "").encode()))) for r in rows])
    edges = _edges(x)
    assert all((a == b).all() for a, b in zip(got.edges, edges, strict=True))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kinds = spark.createDataFrame([(int(r.doc_id in good), v.tolist()) for r, v in zip(rows, x, strict=True)], "kind int, x array<smallint>")
    counted = q._moments(kinds, edges)
    marked = np.array([r.doc_id in good for r in rows])
    for m, own in ((counted[0], x), (counted[1], x[marked]), (counted[2], x[:0])):
        one = np.zeros((len(own), len(edges) * q.BINS))
        np.put_along_axis(one, q.cells(own, edges), 1, 1) if len(own) else None
        assert m.rows == len(own) and (m.pairs == one.T @ one).all()
    seen = q._histograms(kinds, [got])[0]
    assert seen[0].sum() == len(x) and seen[1].sum() == marked.sum()


def test_steps_keep_order():
    x = np.sort(np.abs(np.random.default_rng(1).normal(0, 100, 1000)))
    assert (np.diff(q.steps(x).astype(int)) >= 0).all() and q.steps(np.array([0.0]))[0] == 0
    assert q.steps(np.array([1.0]))[0] < q.steps(np.array([1.01]))[0]


def test_positive_unlabelled_risk():
    """Positives and a mixture are enough to rank what was never labelled negative, to find the prior and the scale."""
    rng = np.random.default_rng(0)
    draw = lambda pos, neg: q.steps(np.concatenate([rng.normal(12, 1, (pos, 2)), rng.normal(9, 1, (neg, 2))]))
    p, u = draw(4000, 0), draw(3000, 2000)
    edges = _edges(u)
    first, every = q.moments(p[:2000], edges), q.moments(u, edges)
    at = lambda m, x: np.bincount(np.clip((m.risen(x) + q.SPAN) / (2 * q.SPAN) * q.CLASSES, 0, q.CLASSES - 1).astype(int), minlength=q.CLASSES)
    other = q.fit(first, every, edges, 0.5)
    prior = q.class_prior(at(other, p[2000:]), at(other, u))
    assert abs(prior - 0.6) < 0.06
    model = q.fit(q.moments(p, edges), every, edges, prior)
    x, y = draw(1000, 1000), np.repeat([1, 0], 1000)
    assert auc(model.risen(x), y) > 0.98
    model = q.scaled(model, at(model, p), at(model, u), prior)
    assert abs(model.scores(u).mean() - prior) < 0.03 and ((model.scores(x) >= 0.5) == y).mean() > 0.95


def test_negative_risk_is_not_left_below_zero():
    """Few positives, many bins, a prior too high: the unbiased minimum has a negative risk of negatives, the result hardly."""
    rng = np.random.default_rng(3)
    p, u = q.steps(rng.normal(12, 2, (40, 6))), q.steps(rng.normal(11, 2, (60, 6)))
    edges = _edges(u)
    mp, mu = q.moments(p, edges), q.moments(u, edges)

    def rest(m: q.Model) -> float:
        return ((m.risen(u) + 1) ** 2).mean() - 0.9 * ((m.risen(p) + 1) ** 2).mean()

    kept, q.STEPS = q.STEPS, 0
    try:
        before = rest(q.fit(mp, mu, edges, 0.9))
    finally:
        q.STEPS = kept
    assert before < 0 and rest(q.fit(mp, mu, edges, 0.9)) > before


def test_given_tables(spark, sf):
    for module, column, least in ((t, "toxic", 0.9), (q, "quality", 0.85)):
        p = module.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
        assert (p.predicted == p[column]).mean() > least
        assert p.score.between(0, 1).all()
        assert (p.held_out == p.doc_id.map(fold)).all()


def test_odd_rows(spark, crowded, odd, empty):
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (8, None, None), (None, 1, 1), (99, 1, 0), (5, 0, 0), (4, 1, 0)], LABELS)
    for module, form in ((t, lambda d: d), (q, q.measured)):
        for labels in (none, some):
            got = module.score(form(crowded), module.learn(form(crowded), labels)).collect()
            assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
            same = {r.score for r in got if r.doc_id in (1, 2)}
            assert len(same) == 1
        assert module.score(form(empty), module.learn(form(empty), none)).count() == 0
    assert {r.score for r in q.score(q.measured(odd), q.learn(q.measured(odd), none)).collect()} == {0.5}
    assert t.clean(crowded, t.learn(crowded, none)).columns == crowded.columns
    assert t.clean(odd.withColumn("text", F.lit(None).cast("string")), t.Model(-3.0, {})).count() == odd.count()


def test_a_mention_shares_no_weight_with_toxic_words():
    """Toxic words begin as a group's name does: with the penalty, the name alone scores no more than a text without it."""
    rng = np.random.default_rng(4)
    y, texts = [], []
    for _ in range(600):
        toxic = rng.random() < 0.4
        texts.append(" ".join([*rng.choice(list("abcdefgh"), 5), *(["womrot", "muslop"] if toxic else [])]))
        y.append(int(toxic))
    hashes = lambda words: np.array(sorted({t.hashed(f) for f in t.features(words)}), np.int32)
    words = [t.counted(x) for x in texts]
    own, none = [hashes(w) for w in words], [None] * len(words)

    def gap(fair: float) -> float:
        _, weights = t.fit(np.array(y, float), own, none, [hashes(t.mentioned(w)) for w in words], fair)
        assert sum(weights.get(h, 0.0) for h in hashes(Counter(["womrot"]))) > 1
        return sum(weights.get(h, 0.0) for h in hashes(Counter(["women"])))

    assert gap(0.0) > 0.3 and abs(gap(t.FAIR)) < 0.1
