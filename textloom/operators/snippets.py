"""The best stretches of prose around matches.

Each match is the middle of a candidate: the matches within half the length either way, the candidate widened to the length and to
spaces nearby. Scores count the matches, those near (the rarer the more), those adjoining, spaces at the sides and exact
case, over how common the term is. Candidates that overlap a better one go. Ties go to the earlier.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.operators.lines import SHORT
from textloom.session import prepare

#: Most matches looked at, most snippets, bytes to look for a space, and what scores count.
MOST_MATCHES, MOST_SNIPPETS, SIDE = 10_000, 20, 10
ADJOINING, SPACED, EXACT, NEAR = 20.0, 5.0, 5.0, 100.0
SNIPPETS = "array<struct<content:string,start:int,end:int,score:double,line_start:int,line_end:int,locs:array<struct<s:int,e:int>>>>"
_SPACES = b" \t\n\v\f\r\x85\xa0"


def _left(text: bytes, at: int) -> tuple[int, bool]:
    for i in range(at, max(-1, at - SIDE - 1), -1):
        if i < len(text) and text[i : i + 1].isspace():
            return i, True
    return at, False


def _right(text: bytes, at: int) -> tuple[int, bool]:
    for i in range(at, min(len(text), at + SIDE)):
        if text[i : i + 1].isspace():
            return i, True
    return at, False


def _starts_character(byte: int) -> bool:
    return byte & 0xC0 != 0x80


def snippets_of(text: bytes, places: list, frequency: dict[str, int], length: int = 300) -> list[dict]:
    any_long = any(len(p["term"].encode()) >= SHORT for p in places)
    found = sorted((p["s"], p["e"], p["term"]) for p in places if not any_long or len(p["term"].encode()) >= SHORT)[:MOST_MATCHES]
    common = {w: max(1, frequency.get(w, 1)) for _, _, w in found}
    reach = length // 2
    candidates = []
    for i, (s, e, word) in enumerate(found):
        first = i
        while first > 0 and e - found[first - 1][0] <= reach:
            first -= 1
        last = i
        while last + 1 < len(found) and found[last + 1][1] - s <= reach:
            last += 1
        # the matches in reach, in the order of their distance to the left, then to the right
        inside = [found[i], *found[first:i][::-1], *found[i + 1 : last + 1]]
        start, end = found[first][0], found[last][1]
        if end - start < length:
            more = (length - (end - start)) // 2
            start, end = max(0, start - more), min(len(text), end + more)
        start, spaced = _left(text, start)
        while not spaced and 0 < start < len(text) and not _starts_character(text[start]):
            start -= 1
        end, spaced = _right(text, end)
        while not spaced and 0 < end < len(text) and not _starts_character(text[end]):
            end -= 1
        start = 0 if start <= SIDE else start
        end = len(text) if len(text) - end <= SIDE else end
        score = float(len(inside))
        for a, b, w in inside:
            if abs(s - (a + (b - a) // 2)) < length // 3:
                score += NEAR / common[w]
        score += ADJOINING * sum(abs(s - b) <= 2 or abs(e - a) <= 2 for a, b, _ in inside)
        score += SPACED * ((s >= 1 and text[s - 1 : s] in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r", b"\x85", b"\xa0")) + (e < len(text) and text[e] in _SPACES))
        score += EXACT * (text[s:e] == word.encode())
        candidates.append((-score / common[word], s, e, start, end))
    kept: list[tuple] = []
    for c in sorted(candidates):
        if not any(a <= c[3] <= b or a <= c[4] <= b for _, _, _, a, b in kept):
            kept.append(c)
    out = []
    for score, _, _, start, end in kept[:MOST_SNIPPETS]:
        line = 1 + text.count(b"\n", 0, start)
        locs = [{"s": a - start, "e": b - start} for a, b, _ in found if a >= start and b <= end]
        out.append({"content": text[start:end].decode("utf-8", "replace"), "start": start, "end": end, "score": -score, "line_start": line, "line_end": line + text.count(b"\n", start, end), "locs": locs})
    return out


def snippets(content: Column, locations: Column, frequency: dict[str, int], length: int = 300, count: int = MOST_SNIPPETS) -> Column:
    """The best snippets of each result; frequency: how often each term stands in all results."""
    prepare()

    @F.pandas_udf(SNIPPETS)
    def found(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([snippets_of(t.encode("utf-8", "surrogatepass"), list(p), frequency, length)[:count] for t, p in zip(texts, places, strict=True)], dtype=object)

    return found(content, locations)


def marked(content: str, locs: list, before: str = "<strong>", after: str = "</strong>", html: bool = True) -> str:
    """A snippet with its matches marked, and the rest escaped for HTML."""
    from html import escape

    quote = escape if html else lambda x, **_: x
    raw, out, at = content.encode(), [], 0
    for loc in sorted(locs, key=lambda x: (x["s"], -x["e"])):
        s, e = max(at, loc["s"]), loc["e"]
        if s < e:
            out += [quote(raw[at:s].decode("utf-8", "replace"), quote=True) if html else raw[at:s].decode("utf-8", "replace"), before, quote(raw[s:e].decode("utf-8", "replace"), quote=True) if html else raw[s:e].decode("utf-8", "replace"), after]
            at = e
    rest = raw[at:].decode("utf-8", "replace")
    return "".join([*out, quote(rest, quote=True) if html else rest])
