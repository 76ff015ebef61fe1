from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import separators as s
from textloom.llm.tokens import END_OF_TEXT, encoder


def slow(ids: list[int]) -> list[tuple]:
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == END_OF_TEXT:
            out.append((len(out), start, i - start))
            start = i + 1
    return out


def blocks_of(file: int, ids: list[int], block: int) -> list[tuple]:
    return [(file, i // block, np.array(ids[i : i + block], "<u2").tobytes()) for i in range(0, len(ids), block)]


def scanned(spark, files: list[list[int]], block: int) -> dict:
    rows = [r for f, ids in enumerate(files) for r in blocks_of(f, ids, block)]
    df = spark.createDataFrame(rows, "file long, block long, ids binary")
    out: dict = {f: [] for f in range(len(files))}
    for r in s.scan(df).orderBy("file", "ordinal").collect():
        out[r.file].append((r.ordinal, r.start, r.n_tokens))
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from([1, 2, END_OF_TEXT]), max_size=40), min_size=1, max_size=3), st.sampled_from([1, 3, 7, 100]))
def test_stitching(spark, files, block):
    assert scanned(spark, files, block) == {f: slow(ids) for f, ids in enumerate(files)}


def test_stitching_over_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "GROUP", 2)
    ids = [5] * 9 + [END_OF_TEXT, END_OF_TEXT] + [5] * 20 + [END_OF_TEXT] + [5] * 3
    assert scanned(spark, [ids, [5] * 4, []], 2) == {0: slow(ids), 1: [], 2: []}


@pytest.mark.parametrize("block", [50, 1 << 16])
def test_documents(spark, documents, rows, block, tmp_path):
    encode = encoder(special=False)
    names = {(r.file, r.ordinal): r.doc_id for r in s.flat_files(documents, f"file://{tmp_path}").collect()}
    (tmp_path / "orphan.bin").write_bytes(b"\x01\x00\x50\xc4")  # of a task that was done again
    found = s.scan(s.read_blocks(spark, str(tmp_path), block)).collect()
    assert {names[r.file, r.ordinal]: r.n_tokens for r in found if r.file != "orphan.bin"} == {r.doc_id: len(encode(r.text or "")) for r in rows}
    # the files hold nothing but ids
    assert sum(f.stat().st_size for f in tmp_path.glob("0*.bin")) == 2 * sum(len(encode(r.text or "")) + 1 for r in rows)


def test_names_of_special_tokens_are_text(spark):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encode = encoder(special=False)
    assert {r.doc_id: r.n_tokens for r in s.counts(df).collect()} == {i: len(encode(t)) for i, t in enumerate(texts)}
    assert END_OF_TEXT not in encode(texts[0]).tolist()


def test_files_on_disk(spark, tmp_path):
    files = {"a.bin": [1, 2, END_OF_TEXT, END_OF_TEXT, 3], "b.bin": [END_OF_TEXT], "c.bin": []}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    got: dict = {}
    for r in s.scan(s.read_blocks(spark, str(tmp_path), 2)).collect():
        got.setdefault(r.file, []).append((r.ordinal, r.start, r.n_tokens))
    assert {k: sorted(v) for k, v in got.items()} == {k: slow(v) for k, v in files.items() if slow(v)}


def test_odd_rows(crowded, odd, empty):
    got = s.counts(crowded).collect()
    assert len(got) == odd.count() and s.counts(empty).count() == 0
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
