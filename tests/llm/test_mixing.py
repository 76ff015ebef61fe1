from __future__ import annotations

import re
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import mixing as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 60))
def test_apportionment_gives_the_highest_quotients(votes, seats):
    got = [0] * len(votes)
    if sum(votes):
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * got[i] + 1), -i))
            got[i] += 1
    assert m.apportion([float(v) for v in votes], seats) == got


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=10))
def test_targets(sizes):
    if not sum(sizes):
        return
    got = m.targets(sizes, m.weights(len(sizes)))
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(t <= m.MOST * s + 1e-6 for t, s in zip(got, sizes, strict=True))
    free = [(t / w) for t, s, w in zip(got, sizes, m.weights(len(sizes)), strict=True) if t < m.MOST * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


def check(rows: list, got: list) -> None:
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r.doc_id] = len(WORD.findall(r.text or ""))
    by: dict = {}
    source = {r.doc_id: r.source for r in rows}
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        by.setdefault(source[r.doc_id], []).append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    for s, n, t in zip(order, sizes, m.targets(sizes, m.weights(len(sizes))), strict=True):
        assert {r.source_size for r in by[s]} == {n}
        assert all(r.target == pytest.approx(t) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= m.BLOCK + 0.03 * t


@pytest.mark.parametrize("shard_rows", [2, 1000])
def test_mix(documents, rows, monkeypatch, shard_rows):
    monkeypatch.setattr(m, "SHARD_ROWS", shard_rows)
    got = m.mix(documents).collect()
    check(rows, got)
    again = {r.doc_id: r.taken for r in m.mix(documents.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mix_beyond_the_broadcast(documents, crowded, monkeypatch):
    """More shards than a broadcast takes: a join by shard, the same rows, null sources too."""
    monkeypatch.setattr(m, "SHARD_ROWS", 2)
    one = [sorted(map(str, m.mix(d).collect())) for d in (documents, crowded)]
    monkeypatch.setattr(m, "MOST_GIVEN", 0)
    other = [m.mix(d) for d in (documents, crowded)]
    assert one == [sorted(map(str, d.collect())) for d in other]
    assert "Broadcast" not in other[0]._jdf.queryExecution().executedPlan().toString()


def test_taken_rows(documents, rows):
    names = documents.columns
    taken = {r.doc_id: r.taken for r in m.mix(documents).collect()}
    out = m.taken_rows(documents)
    assert out.columns == names
    text = {r.doc_id: r.text for r in rows}
    words: dict = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert words == {k: v for k, v in taken.items() if v}


def test_odd_rows(crowded, odd, empty):
    got = m.mix(crowded).collect()
    assert len(got) == odd.count()
    assert all(r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert m.mix(empty).count() == 0 and m.taken_rows(empty).count() == 0
    assert m.taken_rows(crowded).columns == crowded.columns
