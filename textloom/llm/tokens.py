"""Token ids of a public vocabulary, for packing and token counts.

The vocabulary is given as a tokenizers file by path. Where the rank table of the same vocabulary lies beside that file, ids of
texts without a special string come from it (a byte-level encoder with the same split pattern, several times as fast; a
test compares them); all other ids come from the file. Special strings in a text are the tokens that they name, as the file's tokenizer has
it, or ordinary text where that is asked for.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable
from functools import cache

import numpy as np

#: Name of the public vocabulary, and the id that its special token for a text's end has.
VOCABULARY, END_OF_TEXT = "byte_bpe_50k.json", 50256


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _filed(path: str, special: bool):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not special
    return t


@cache
def _added(path: str) -> tuple[str, ...]:
    """Strings that the file's tokenizer takes out of a text before all else."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens") or [])


def encoder(path: str | None = None, ranks: bool = True, special: bool = True) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids as unsigned 32-bit numbers; special: whether special strings in it are special tokens."""
    path = str(path or vocabulary_path())
    ranked = path.removesuffix(".json") + ".tiktoken"
    filed = _filed(path, special)
    full = lambda text: np.array(filed.encode(text, add_special_tokens=False).ids, np.uint32)
    if not ranks or not os.path.exists(ranked):
        return full
    added = _added(path)
    encode = _ranked(ranked).encode_ordinary
    return lambda text: full(text) if any(a in text for a in added) else np.array(encode(text), np.uint32)
