"""Code, comments and strings of a file, its line counts, and what its matches are part of."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.languages import SYNTAX, declares, has_declarations, is_declaration_line
from textloom.session import prepare

CODE, COMMENT, STRING, BLANK = "code", "comment", "string", "blank"
CLASSES = "array<struct<s:int,e:int,cls:string>>"
STATS = "struct<lines:bigint,code:bigint,comment:bigint,blank:bigint,complexity:bigint>"
ANNOTATED = "array<struct<term:string,s:int,e:int,cls:string,declares:boolean,on_declaration:boolean>>"


def has_lexis(language: str) -> bool:
    """Whether anything is known of a language's text, so that its places differ."""
    return language in SYNTAX or has_declarations(language)


@cache
def _opener(language: str) -> re.Pattern[bytes]:
    syntax = SYNTAX[language]
    openers = [*(a for a, _ in syntax.block), *syntax.line, *(a for a, _ in syntax.strings)]
    return re.compile(b"|".join(re.escape(o.encode()) for o in sorted(openers, key=len, reverse=True)))


def classes(content: bytes, language: str) -> list[tuple[int, int, str]]:
    """Runs (start, end, class) that cover a file of a known language; none for others."""
    if language not in SYNTAX or not content:
        return []
    syntax = SYNTAX[language]
    blocks = {a.encode(): b.encode() for a, b in syntax.block}
    strings = {a.encode(): b.encode() for a, b in syntax.strings}
    out: list[tuple[int, int, str]] = []
    at = 0

    def put(s: int, e: int, cls: str) -> None:
        if e > s:
            out.append((s, e, cls))

    while at < len(content):
        m = _opener(language).search(content, at)
        if not m:
            break
        opened, start = m[0], m.start()
        if opened in blocks:
            start += opened.startswith(b"\n")
            end = content.find(blocks[opened], m.end())
            end = len(content) if end < 0 else end + len(blocks[opened])
            cls = COMMENT
        elif opened in strings:
            closer = strings[opened]
            plain = len(closer) == 1 and closer != b"`"
            end = m.end()
            while end < len(content) and not content.startswith(closer, end) and not (plain and content[end] == 10):
                end += 2 if content[end] == 92 and closer != b"`" else 1
            end = min(len(content), end + (len(closer) if content.startswith(closer, end) else 0))
            cls = STRING
        else:
            end = content.find(b"\n", start)
            end = len(content) if end < 0 else end
            cls = COMMENT
        put(at, start, CODE)
        put(start, end, cls)
        at = end
    put(at, len(content), CODE)
    # white space alone is blank
    return [(s, e, BLANK if cls == CODE and not content[s:e].strip() else cls) for s, e, cls in out]


def stats(content: bytes, language: str) -> dict[str, int]:
    """Lines by kind, and the number of branches outside comments and strings."""
    lines = content.split(b"\n")
    if lines and not lines[-1]:
        lines.pop()
    runs = classes(content, language)
    if not runs:
        blank = sum(not x.strip() for x in lines)
        return {"lines": len(lines), "code": len(lines) - blank, "comment": 0, "blank": blank, "complexity": 0}
    masked = bytearray(content)
    noted = bytearray(content)
    for s, e, cls in runs:
        if cls in (COMMENT, STRING):
            masked[s:e] = bytes(10 if c == 10 else 32 for c in content[s:e])
        if cls == COMMENT:
            noted[s:e] = masked[s:e]
    counts = {"code": 0, "comment": 0, "blank": 0}
    for raw, left in zip(lines, bytes(noted).split(b"\n"), strict=False):
        counts["blank" if not raw.strip() else "code" if left.strip() else "comment"] += 1
    code = bytes(masked)
    branches = sum(len(re.findall((rb"\b" if b[0].isalpha() else b"") + re.escape(b.encode()), code)) for b in SYNTAX[language].branches)
    return {"lines": len(lines), **counts, "complexity": branches}


def class_at(runs: list[tuple[int, int, str]], at: int) -> str | None:
    i = bisect.bisect_right(runs, at, key=lambda r: r[0]) - 1
    return runs[i][2] if 0 <= i and runs[i][0] <= at < runs[i][1] else None


def marks(content: bytes, language: str, places: Iterable[int]) -> Iterator[tuple[str | None, bool, bool]]:
    """For each place in turn, the class of its byte (None if unknown), whether it is what its line declares, and whether its line declares anything."""
    if not has_lexis(language):
        yield from ((None, False, False) for _ in places)
        return
    runs = classes(content, language)
    starts = [0, *(m.end() for m in re.finditer(b"\n", content) if m.end() < len(content))]
    for at in places:
        found = line_declares = False
        if 0 <= at < len(content):
            i = bisect.bisect_right(starts, at) - 1
            end = starts[i + 1] - 1 if i + 1 < len(starts) else len(content)
            line = content[starts[i] : end]
            bare = line.lstrip(b" \t")
            text = bare.decode("utf-8", "replace")
            before = bare[: max(0, at - starts[i] - (len(line) - len(bare)))].decode("utf-8", "replace")
            column = len(before) if at - starts[i] >= len(line) - len(bare) else -1
            found, line_declares = declares(text, column, language), is_declaration_line(text, language)
        yield class_at(runs, at), found, line_declares


def annotated(content: bytes, language: str, spans: list) -> list[dict]:
    """Spans with what marks() tells of their first byte."""
    found = marks(content, language, (x["s"] for x in spans))
    return [{"term": x["term"], "s": x["s"], "e": x["e"], "cls": c, "declares": d, "on_declaration": on} for x, (c, d, on) in zip(spans, found, strict=True)]


def byte_classes(content: Column, language: Column) -> Column:
    prepare()
    @F.pandas_udf(CLASSES)
    def found(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([[{"s": s, "e": e, "cls": c} for s, e, c in classes(t.encode("utf-8", "surrogatepass"), k)] for t, k in zip(texts, languages, strict=True)], dtype=object)

    return found(content, language)


def code_stats(content: Column, language: Column) -> Column:
    prepare()
    @F.pandas_udf(STATS)
    def counted(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
        names = ["lines", "code", "comment", "blank", "complexity"]
        return pd.DataFrame([stats(t.encode("utf-8", "surrogatepass"), k) for t, k in zip(texts, languages, strict=True)], columns=names).astype("int64")

    return counted(content, language)


def annotate(content: Column, language: Column, locations: Column) -> Column:
    prepare()
    @F.pandas_udf(ANNOTATED)
    def noted(texts: pd.Series, languages: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([annotated(t.encode("utf-8", "surrogatepass"), k, list(x) if x is not None else []) for t, k, x in zip(texts, languages, spans, strict=True)], dtype=object)

    return noted(content, language, locations)
