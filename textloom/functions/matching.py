"""Where terms stand in a text, in bytes.

Literal terms are found without overlap, regardless of case by lower-casing (with offsets of the text as it is, also where
that changes lengths); regular expressions leftmost and without overlap; fuzzy terms at every window of the term's length in bytes
within the distance, overlapping.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.patterns import python_regex
from textloom.query.nodes import Fuzzy, Keyword, Node, Phrase, Regex
from textloom.session import prepare

SPANS = "array<struct<term:string,s:int,e:int>>"


class Span(NamedTuple):
    term: str
    s: int
    e: int


def byte_offsets(text: str) -> np.ndarray | None:
    """Byte offset of each character and of the end; None if they are the same as the characters'."""
    if text.isascii():
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    return np.concatenate([[0], np.cumsum(size)])


def lowered(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case, and, if that has another length, for each of its characters the one it comes from."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    parts = [c.lower() for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p] + [len(text)]


def literal_spans(text: str, term: str, sensitive: bool) -> list[tuple[int, int]]:
    if not term:
        return []
    origin = None
    if not sensitive:
        text_, origin = lowered(text)
        term = term.lower()
    else:
        text_ = text
    offsets = byte_offsets(text)
    out, at = [], text_.find(term)
    while at >= 0:
        end = at + len(term)
        s, e = at, end
        if origin:
            s, e = origin[s], origin[e - 1] + 1
        out.append((int(offsets[s]), int(offsets[e])) if offsets is not None else (s, e))
        at = text_.find(term, end)
    return out


def regex_spans(text: str, pattern: str) -> list[tuple[int, int]]:
    found = python_regex(pattern)
    if found is None:
        return []
    offsets = byte_offsets(text)
    spans = (m.span() for m in found.finditer(text))
    return [(int(offsets[s]), int(offsets[e])) if offsets is not None else (s, e) for s, e in spans]


def fuzzy_windows(text: bytes, term: bytes, distance: int) -> np.ndarray:
    """Starts of the windows of the term's length within an edit distance, by one banded table for all windows at once."""
    m, n = len(term), len(text) - len(term) + 1
    if not m or n < 1:
        return np.zeros(0, np.int64)
    x = np.frombuffer(text, np.uint8)
    before = {j: np.full(n, j, np.int8) for j in range(min(m, distance) + 1)}
    for i in range(1, m + 1):
        now: dict[int, np.ndarray] = {}
        for j in range(max(0, i - distance), min(m, i + distance) + 1):
            if j == 0:
                now[0] = np.full(n, i, np.int8)
                continue
            best = before[j - 1] + (x[j - 1 : j - 1 + n] != term[i - 1]) if j - 1 in before else None
            for other in (before.get(j), now.get(j - 1)):
                if other is not None:
                    best = other + 1 if best is None else np.minimum(best, other + 1)
            now[j] = best.astype(np.int8)
        before = now
    return np.flatnonzero(before[m] <= distance)


def fuzzy_spans(text: str, term: str, distance: int, sensitive: bool) -> list[tuple[int, int]]:
    if sensitive:
        raw, want = text.encode("utf-8", "surrogatepass"), term.encode("utf-8", "surrogatepass")
        return [(int(s), int(s) + len(want)) for s in fuzzy_windows(raw, want, distance)]
    low, origin = lowered(text)
    raw, want = low.encode("utf-8", "surrogatepass"), term.lower().encode("utf-8", "surrogatepass")
    starts = fuzzy_windows(raw, want, distance)
    if not len(starts) or len(raw) == len(text):
        return [(int(s), int(s) + len(want)) for s in starts]
    chars = byte_offsets(low)
    offsets = byte_offsets(text)
    if offsets is None:
        offsets = np.arange(len(text) + 1)
    if chars is None:
        chars = np.arange(len(low) + 1)
    origin = np.arange(len(text) + 1) if origin is None else np.array(origin)
    out = []
    for s in starts.tolist():  # back to the text as it is: inside a character, the offset goes along
        a, b = (int(np.searchsorted(chars, p, side="right")) - 1 for p in (s, s + len(want)))
        out.append((int(offsets[origin[a]] + (s - chars[a])), int(offsets[origin[b]] + (s + len(want) - chars[b]))))
    return out


def spans_of(text: str, node: Node, sensitive: bool) -> list[tuple[int, int]]:
    if isinstance(node, Regex):
        return regex_spans(text, node.pattern)
    if isinstance(node, Fuzzy):
        return fuzzy_spans(text, node.value, node.distance, sensitive)
    return literal_spans(text, node.value, sensitive)


def term_of(node: Node) -> str:
    return node.pattern if isinstance(node, Regex) else node.value


def phrase_term(query: str) -> str | None:
    """What a whole query of several words is found as, beside its terms."""
    words = query.strip('"')
    return words if " " in words.strip() else None


def locate(text: Column, nodes: list[Node], sensitive: bool = False, query: str | None = None) -> Column:
    """All places of the terms, by term as queried, then start; with a query of several words, of the words as a whole too."""
    prepare()
    whole = phrase_term(query) if query else None

    @F.pandas_udf(SPANS)
    def located(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[dict]:
            found = {term_of(n): spans_of(t, n, sensitive) for n in nodes}
            if whole and (spans := literal_spans(t, whole, False)):
                found[query] = spans
            return [{"term": k, "s": s, "e": e} for k, v in found.items() for s, e in v]

        return texts.fillna("").map(one)

    return located(text)


def fuzzy(text: Column, term: str, distance: int, sensitive: bool = False) -> Column:
    """Whether a fuzzy term stands in a text."""
    prepare()
    want = term if sensitive else term.lower()
    raw = want.encode("utf-8", "surrogatepass")

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        low = texts.fillna("")
        return low.map(lambda t: bool(len(fuzzy_windows((t if sensitive else t.lower()).encode("utf-8", "surrogatepass"), raw, distance))))

    return found(text)


def levenshtein_bytes(a: str, b: str) -> int:
    """The edit distance of two texts' UTF-8 bytes."""
    x, y = a.encode(), b.encode()
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1]


def occurrences(text: Column, node: Node, sensitive: bool = False) -> Column | None:
    """How often a term stands in a text with built-in functions; None where they can't tell (fuzzy terms)."""
    from textloom.functions.patterns import java_regex

    if isinstance(node, Keyword | Phrase):
        if not node.value:
            return F.lit(0)
        t, v = (text, node.value) if sensitive else (F.lower(text), node.value.lower())
        gone = F.octet_length(F.replace(t, F.lit(v), F.lit("")))
        return ((F.octet_length(t) - gone) / len(v.encode())).cast("int")
    if isinstance(node, Regex):
        made = java_regex(node.pattern)
        return F.lit(0) if made is None else F.regexp_count(text, F.lit(made))
    return None
