from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import packing as p
from textloom.llm.tokens import encoder, vocabulary_path


def check(pieces: list, docs: dict[int, list[np.ndarray]], length: int, padded: int) -> None:
    """Each id in one piece, sequences without gaps within their length, little padding."""
    by: dict = {}
    for r in pieces:
        by.setdefault(r[5], []).append((r[6], r[2]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= length
    assert sum(length - sum(n for _, n in s) for s in by.values()) <= padded * length
    for doc_id, copies in docs.items():
        own = sorted((r[1], r[2], r[3], r[4]) for r in pieces if r[0] == doc_id)
        want = len(copies)
        covered = 0
        for start, n, crc, total in own:
            assert total == len(copies[0])
            assert zlib.crc32(copies[0][start : start + n].astype("<u4").tobytes()) == crc
            covered += n
        assert covered == want * len(copies[0])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(1, 200))
def test_packer(sizes, window):
    packer = p.Packer(0, 16, window)
    docs, pieces = {}, []
    for i, n in enumerate(sizes):
        ids = np.arange(n, dtype=np.uint32) + i * 100
        docs[i] = [ids]
        pieces += packer.add(i, ids)
    pieces += packer.flush()
    check(pieces, docs, 16, 1)


def test_documents_go_to_the_cheapest_sequence_with_room():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 2048, 400).tolist()
    pieces, spare = p.assign(sizes, 0)
    count = -(-sum(sizes) // 2048)
    room, paid = [2048] * count, [0.0] * count
    room[-1] -= spare
    cut = 0
    for item, _, n, s in pieces:
        s -= 1  # 0 is the sequence left open before
        if n == sizes[item]:
            best = min(paid[x] for x in range(count) if room[x] >= n)
            assert paid[s] == best
        else:
            cut += 1
        room[s] -= n
        paid[s] += p.cost(n)
    assert set(room) == {0} and 0 <= spare < 2048
    sized = [n for _, _, n, _ in pieces]
    assert [sizes[i] for i in dict.fromkeys(x[0] for x in pieces)] == sorted(sizes, reverse=True)
    assert cut and len(sized) < 2 * len(sizes)


def test_same_ids_as_the_vocabulary_file(rows):
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(vocabulary_path())
    fast, plain = encoder(), encoder(special=False)
    for text in [r.text for r in rows[:60]] + ["", "a<|endoftext|>b", "<|endoftext|> x <|endoftext|>", "<|endoftext", "  \n\n é 😀 ", "a" * 3000]:
        want = file.encode(text, add_special_tokens=False).ids
        assert fast(text).tolist() == want
        assert (plain(text).tolist() == want) == (50256 not in want)
    assert vocabulary_path().endswith("byte_bpe_50k.json")


def test_documents(documents, rows):
    encode = encoder()
    docs = {r.doc_id: [np.append(encode(r.text or ""), np.uint32(1))] for r in rows}
    check([tuple(r) for r in p.pack(documents).collect()], docs, 2048, documents.rdd.getNumPartitions())


def test_odd_rows(crowded, odd, empty):
    encode = encoder()
    docs: dict = {}
    for r in odd.collect():
        docs.setdefault(r.doc_id, []).append(np.append(encode(r.text or ""), np.uint32(1)))
    check([tuple(r) for r in p.pack(crowded).collect()], docs, 2048, 8)
    assert p.pack(empty).count() == 0


@pytest.mark.parametrize("length", [1, 2, 7])
def test_short_sequences(length):
    packer = p.Packer(5, length, 10)
    ids = np.arange(20, dtype=np.uint32)
    check([*packer.add(1, ids), *packer.flush()], {1: [ids]}, length, 1)
