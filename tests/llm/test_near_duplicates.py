from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import near_duplicates as nd
from textloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text: str | None, k: int) -> frozenset:
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows: list[tuple], k: int, least: int = 80) -> dict:
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    index: dict = {}
    pairs = set()
    for i in ids:
        for g in sets[i]:
            pairs.update((j, i) for j in index.get(g, ()))
            index.setdefault(g, []).append(i)
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def check(df, rows, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, words=k).collect()}
    assert got == brute(rows, k)


def test_given_documents(documents, rows):
    check(documents, [(r.doc_id, r.text) for r in rows], 4)


@pytest.mark.parametrize("block", [512, 8])
def test_families(spark, monkeypatch, block):
    """Many variants of a text, at all likenesses, chains among them; texts that share a passage; small and large blocks."""
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    base, passage, texts = word(120), word(60), []
    for i in range(150):
        t = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 9)):
            t[j] = word(1)[0]
        texts.append(" ".join(t))
    chain = word(100)
    for i in range(30):
        chain[i * 3] = word(1)[0]
        texts.append(" ".join(chain))
    texts += [" ".join(passage + word(rng.integers(5, 60))) for _ in range(80)]
    texts += texts[:20] + [texts[0]] * 30
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[j]) for i, j in enumerate(order)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, 5)


@settings(max_examples=50, deadline=None)
@given(st.text("ab \n Éé", max_size=40), st.sampled_from([1, 4]))
def test_shingles_are_counted_as_defined(text, k):
    assert len(nd.shingles(text.encode(), k)) == len(shingle_set(text, k))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.0, 0.3, 0.6, 0.8, 0.95, 1.0):
        n = 2000
        common = rng.integers(0, 1 << 63, int(n * 2 * share / (1 + share)), dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)]) for _ in range(2))
        ra, rb = nd.registers(a), nd.registers(b)
        assert (nd.merged(ra, rb) == nd.registers(np.concatenate([a, b]))).all()
        j = len(common) / (2 * n - len(common))
        got = float(nd.likely_similarity((ra > rb).sum(), (ra < rb).sum(), n, n))
        errors.append(abs(got - j))
    assert max(errors) < 5 * (0.25 / nd.REGISTERS) ** 0.5 and np.mean(errors) < 0.05
    assert nd.registers(np.zeros(0, np.uint64)).tolist() == [0] * nd.REGISTERS


def test_threshold_is_exact():
    a = np.arange(90, dtype=np.uint64)
    assert nd.linked(a, a[:72]) and not nd.linked(a, a[:71])
    assert not nd.linked(a, a[:0]) and not nd.linked(a[:0], a[:0])


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 230)] + [(500, x) for x in range(501, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(find(x) == got.get(x, x) for x in root)
    known = components(spark.createDataFrame(links[:60], "a long, b long"))
    got = {r.node: r.root for r in components(spark.createDataFrame(links[60:], "a long, b long"), known).collect()}
    assert all(find(x) == got.get(x, x) for x in root)


def test_rows_without_an_id_hide_no_links(spark):
    """Classes of rows with a null doc_id, more copies than any other, between documents that are linked; ids that texts share."""
    rng = np.random.default_rng(6)
    data, want = [], {}
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(120)]
        near = [" ".join(base[:k] + [f"x{g}{k}"] + base[k + 1 :]) for k in (10, 30, 50, 70)]
        data += [(10 * g + 2, near[0]), (10 * g + 3, near[1])] + [(None, near[2])] * 5 + [(None, near[3])]
        want |= {10 * g + 2: (10 * g + 2, True), 10 * g + 3: (10 * g + 2, False)}
    alone = [" ".join(f"y{g}w{i}" for i in range(40)) for g in range(4)]
    data += [(None, alone[0])] * 2 + [(None, alone[0] + " more"), (5000, alone[1]), (5000, alone[2]), (5001, alone[2])]
    data = [data[i] for i in rng.permutation(len(data))]
    got = nd.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == len(data)
    assert {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id is not None and r.doc_id < 5000} == want
    nameless = [r for r in got if r.doc_id is None]
    assert sum(r.component_id is not None and not r.kept for r in nameless) == 180
    assert {r.kept for r in nameless if r.component_id is None} == {True, False}
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id and r.doc_id >= 5000) == [(5000, 5000, True), (5000, 5000, True), (5001, 5000, False)]


def test_repeats_are_told_by_their_texts(spark):
    """Rows with no id, or the same one, are different documents unless their texts are alike."""
    text = lambda g, end="": " ".join(f"t{g}w{i}" for i in range(40)) + end
    given = [(None, text(0)), (None, text(1)), (None, text(1).upper()), (None, text(2)), (None, text(2, " more")), (7, text(3)), (None, text(3)), (8, text(4)), (8, text(5)), (8, text(5)), (9, text(6)), (10, text(6)), (None, ""), (None, ""), (None, " "), (None, None)]
    left = nd.one_of_each(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, ("none" if r.text is None else r.text.lower()[:4])) for r in left) == sorted([(0, "t0w0"), (0, "t1w0"), (0, "t2w0"), (7, "t3w0"), (8, "t4w0"), (8, "t5w0"), (9, "t6w0"), (0, ""), (0, " "), (0, "none")])


def test_odd_rows(crowded, odd, empty):
    got = nd.near_duplicates(crowded).collect()
    assert len(got) == odd.count() and nd.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert (by[1].n_shingles, by[1].component_id, by[2].component_id) == (0, 1, 2)
    assert by[5].component_id == by[6].component_id == 5 and by[3].kept
    left = nd.one_of_each(crowded)
    assert left.columns == crowded.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "9", "None"])
