"""Lines of results: all matching lines with context as DataFrame operations, the best lines and clusters of them by an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import prepare

#: Most matching lines that are looked at, lines of a result, what a match on a line counts, bytes of a term that isn't short.
MOST_MATCHING, MOST_LINES, PER_MATCH, SHORT = 101, 15, 4.0, 2
LINES = "array<struct<line_number:int,content:string,score:double,locs:array<struct<s:int,e:int>>>>"


def numbered(docs: DataFrame, keys: tuple[str, ...] = ("path",), *more: str) -> DataFrame:
    """keys, line (from 1), start (in bytes), content of each line."""
    lines = F.split("content", "\n")
    ends = F.transform(lines, lambda x: F.octet_length(x) + 1)
    starts = F.aggregate(ends, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])
    rows = docs.select(*keys, *more, F.posexplode(F.arrays_zip(starts.alias("start"), lines.alias("text"))).alias("i", "x"))
    return rows.select(*keys, *more, (F.col("i") + 1).alias("line"), F.col("x.start").alias("start"), F.col("x.text").alias("content"))


def long_enough(locations: Column) -> Column:
    """Places without those of short terms, where there are terms that aren't short."""
    any_long = F.exists(locations, lambda x: F.octet_length(x["term"]) >= SHORT)
    return F.filter(locations, lambda x: ~any_long | (F.octet_length(x["term"]) >= SHORT))


def grep(hits: DataFrame, limit: int = 0, before: int = 0, after: int = 0) -> DataFrame:
    """path, line, content, is_match, locs of all matching lines, and of those around them; limit counts matching lines of a document."""
    lines = numbered(hits.withColumn("_at", long_enough(F.col("match_locations"))), ("path",), "_at")
    size = F.octet_length("content")
    rel = lambda x: F.struct(F.greatest(F.lit(0), x["s"] - F.col("start")).alias("s"), F.least(size, x["e"] - F.col("start")).alias("e"))
    inside = lambda x: (x["s"] < F.col("start") + size) & (x["e"] > F.col("start"))
    lines = lines.withColumn("locs", F.transform(F.filter("_at", inside), rel)).drop("_at")
    lines = lines.withColumn("is_match", F.size("locs") > 0)
    by_line = Window.partitionBy("path").orderBy("line")
    if limit > 0:
        rank = F.sum(F.col("is_match").cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
        lines = lines.withColumn("is_match", F.col("is_match") & (rank <= limit))
    if before > 0 or after > 0:
        # a line is context if one within `after` lines before it, or `before` lines behind it, matches
        shown = F.max(F.col("is_match")).over(by_line.rowsBetween(-max(0, after), max(0, before)))
        lines = lines.withColumn("_shown", shown).where("_shown").drop("_shown")
    else:
        lines = lines.where("is_match")
    content = F.regexp_replace("content", r"\r+\z", "")
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    locs = F.when(F.col("is_match"), F.transform("locs", lambda x: F.struct(x["s"].alias("s"), F.least(x["e"], F.octet_length(content)).alias("e")))).otherwise(none)
    return lines.select("path", "line", content.alias("content"), "is_match", locs.alias("locs"))


def with_gaps(lines: DataFrame) -> DataFrame:
    """Lines with gap: whether some are left out before one."""
    before = F.lag("line").over(Window.partitionBy("path").orderBy("line"))
    return lines.withColumn("gap", F.coalesce(F.col("line") > before + 1, F.lit(False)))


def _lines(content: bytes, places: list) -> tuple[list[bytes], list[dict]]:
    """All lines of a content, and the first matching ones, best first."""
    lines = content.split(b"\n")
    any_long = any(len(p["term"].encode()) >= SHORT for p in places)
    places = sorted(((p["s"], p["e"]) for p in places if not any_long or len(p["term"].encode()) >= SHORT))
    found, at = [], 0
    for i, raw in enumerate(lines):
        end = at + len(raw)
        shown = raw.rstrip(b"\r")
        locs = [(max(0, s - at), min(len(shown), e - at)) for s, e in places if s < end and e > at]
        if locs:
            found.append({"line": i, "locs": locs, "score": PER_MATCH * len(locs)})
            if len(found) == MOST_MATCHING:
                break
        at = end + 1
    return lines, sorted(found, key=lambda x: (-x["score"], x["line"]))


def _shown(lines: list[bytes], chosen: list[int], matching: dict[int, dict]) -> list[dict]:
    out = []
    for i in sorted(chosen):
        m = matching.get(i, {"locs": [], "score": 0.0})
        text = lines[i].rstrip(b"\r").decode("utf-8", "replace")
        out.append({"line_number": i + 1, "content": text, "score": m["score"], "locs": [{"s": s, "e": e} for s, e in m["locs"]]})
    return out


def _around(i: int, surround: int, n: int):
    for d in range(1, surround + 1):
        if i - d >= 0:
            yield i - d, d
        if i + d < n:
            yield i + d, d


def best_lines_of(content: bytes, places: list, surround: int = 2) -> list[dict]:
    """The best matching lines with those around them, until there are MOST_LINES behind an anchor."""
    lines, found = _lines(content, places)
    chosen: dict[int, None] = {}
    for m in found:
        if m["line"] in chosen:
            continue
        chosen[m["line"]] = None
        chosen.update(dict.fromkeys(i for i, _ in _around(m["line"], surround, len(lines))))
        if len(chosen) >= MOST_LINES:
            break
    return _shown(lines, list(chosen), {m["line"]: m for m in found})


def clusters_of(content: bytes, places: list, count: int = 1, surround: int = 2) -> list[list[dict]]:
    """Up to count groups of lines around one anchor each, without lines in common."""
    lines, found = _lines(content, places)
    used: set[int] = set()
    out = []
    for m in found:
        if len(out) >= max(1, count):
            break
        if m["line"] in used:
            continue
        own = [m["line"]]
        used.add(m["line"])
        last = 0
        for i, d in _around(m["line"], surround, len(lines)):
            if d != last and len(own) >= MOST_LINES:
                break
            last = d
            if i not in used:
                own.append(i)
                used.add(i)
        out.append(_shown(lines, own, {x["line"]: x for x in found}))
    return out


def best_lines(content: Column, locations: Column, surround: int = 2) -> Column:
    prepare()
    @F.pandas_udf(LINES)
    def found(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([best_lines_of(t.encode("utf-8", "surrogatepass"), list(p), surround) for t, p in zip(texts, places, strict=True)], dtype=object)

    return found(content, locations)


def clusters(content: Column, locations: Column, count: int, surround: int = 2) -> Column:
    prepare()
    @F.pandas_udf(f"array<{LINES}>")
    def found(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([clusters_of(t.encode("utf-8", "surrogatepass"), list(p), count, surround) for t, p in zip(texts, places, strict=True)], dtype=object)

    return found(content, locations)
