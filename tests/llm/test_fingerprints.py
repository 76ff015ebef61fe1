from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import fingerprints as f


def slow(text: str) -> list[int]:
    """The same values from k-mers counted in a dict and sorted in full, by numbers taken one at a time."""
    if not text:
        return f.EMPTY.tolist()
    h, at = f.numbered_kmers(np.array([ord(c) for c in text], np.uint32))
    out = []
    for odd in f._ODD:
        best = sorted((int(np.uint32(int(x) * int(odd) & 0xFFFFFFFF)), int(p), int(x)) for x, p in zip(h, at, strict=True))[: f.LENGTH]
        value = np.array([len(best)], np.uint32)
        for _, x in sorted((p, x) for _, p, x in best):
            value = f._mixed(value * np.uint32(0x01000193) + np.uint32(x))
        out.append(int(value[0]))
    return out


@settings(max_examples=40, deadline=None)
@given(st.text("abc \U0001f600", max_size=80))
def test_values(text):
    assert f.fingerprint(text).tolist() == slow(text)


def test_occurrences_are_numbered():
    h, at = f.numbered_kmers(np.array([97] * 30, np.uint32))
    assert len(set(h.tolist())) == 15 and sorted(at.tolist()) == list(range(15))


def test_likeness_follows_edits():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefghij "), 4000))
    few, many = list(text), list(text)
    for i in rng.integers(0, 4000, 10):
        few[i] = "Z"
    for i in rng.integers(0, 4000, 200):
        many[i] = "Z"
    own = f.fingerprint(text)
    near, far = f.likeness(own, f.fingerprint("".join(few))), f.likeness(own, f.fingerprint("".join(many)))
    assert f.likeness(own, own) == 1 and near > far and near > 0.6
    # the same k-mers in another order differ
    swapped = text[2000:] + text[:2000]
    assert f.likeness(own, f.fingerprint(swapped)) < 0.75


def _check(rows: list[tuple], got: dict) -> None:
    order = sorted(rows, key=lambda r: r[0])
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == f.text_of(f.fingerprint(text)) and r.edited_fingerprint == f.text_of(f.fingerprint(changed))
        assert r.near_edited == f.likeness(f.fingerprint(text), f.fingerprint(changed))
        assert r.near_next == f.likeness(f.fingerprint(text), f.fingerprint(following))


@pytest.mark.parametrize("run_rows", [3, 1000])
def test_neighbours(documents, rows, monkeypatch, run_rows):
    monkeypatch.setattr(f, "RUN_ROWS", run_rows)
    got = f.neighbours(documents).collect()
    assert len(got) == len(rows)
    _check([(r.doc_id, r.text) for r in rows], {r.doc_id: r for r in got})


def test_odd_rows(crowded, odd, empty):
    got = f.neighbours(crowded).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        assert by.setdefault((r.doc_id, r.n_chars), r.fingerprint) == r.fingerprint
    assert by[1, 0] == by[2, 0] and by[5, 28] == by[6, 28]
    assert f.neighbours(empty).count() == 0
    one = odd.where("doc_id = 5")
    assert f.neighbours(one).first().near_next == 1.0
    assert f.fingerprints(odd).count() == odd.count()
