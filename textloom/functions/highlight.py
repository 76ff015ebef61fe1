"""Code shown with its parts marked: runs of kinds, over which matches win, as HTML or with terminal colours.

One scanner serves all languages. Keywords are the common words of any language.
"""

from __future__ import annotations

import re
from functools import cache
from html import escape
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.languages import STOPWORDS
from textloom.session import prepare

MATCH, PLAIN = "match", "plain"
_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
  | (?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`[^`]*`?)
  | (?P<number>\b\d[\w.]*)
  | (?P<word>[^\W\d]\w*)
  | (?P<whitespace>\s+)
  | (?P<punctuation>.)""",
    re.VERBOSE | re.DOTALL,
)
#: Terminal colours of kinds; what has none stays as it is.
COLOURS = {"keyword": 75, "type": 79, "string": 114, "comment": 245, "number": 215, MATCH: 203}


@cache
def keywords() -> frozenset[str]:
    return frozenset().union(*STOPWORDS.values())


def kinds(text: str) -> list[tuple[int, int, str]]:
    """Runs (start, end, kind) in characters that cover a text."""
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            kind = "keyword" if m[0] in keywords() else "type" if m[0][0].isupper() else PLAIN
        out.append((m.start(), m.end(), kind))
    return out


def marked_runs(text: str, matches: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """(text, kind) of the runs, cut at matches (in bytes), which win over what they stand in."""
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode("utf-8", "surrogatepass")))
    char = {b: i for i, b in enumerate(at)}
    near = lambda b: char.get(b, next((i for i, x in enumerate(at) if x > b), len(text) + 1) - 1)
    spans = [(near(s), near(e)) for s, e in matches if e > s]
    runs = kinds(text)
    cuts = sorted({0, len(text), *(x for s in spans for x in s), *(r[0] for r in runs)})
    out: list[tuple[str, str]] = []
    k = 0
    for a, b in pairwise(cuts):
        while k < len(runs) and runs[k][1] <= a:
            k += 1
        kind = MATCH if any(s <= a < e for s, e in spans) else runs[k][2] if k < len(runs) else PLAIN
        if out and out[-1][1] == kind:
            out[-1] = (out[-1][0] + text[a:b], kind)
        else:
            out.append((text[a:b], kind))
    return out


def as_html(text: str, matches: list[tuple[int, int]] = ()) -> str:
    def one(part: str, kind: str) -> str:
        part = escape(part)
        if kind == MATCH:
            return f"<strong>{part}</strong>"
        return part if kind in (PLAIN, "whitespace", "punctuation") else f'<span class="{kind}">{part}</span>'

    return "".join(one(*r) for r in marked_runs(text, list(matches)))


def as_ansi(text: str, matches: list[tuple[int, int]] = ()) -> str:
    return "".join(f"\033[38;5;{COLOURS[k]}m{p}\033[0m" if k in COLOURS else p for p, k in marked_runs(text, list(matches)))


def html(content: Column, locs: Column) -> Column:
    """Lines as HTML with their matches marked; locs: array of structs s, e in bytes."""
    prepare()

    @F.pandas_udf("string")
    def shown(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([as_html(t, [(x["s"], x["e"]) for x in p]) for t, p in zip(texts, places, strict=True)], dtype=object)

    return shown(content, locs)
