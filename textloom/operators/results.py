"""Results in order: duplicates, pages, facets, and the sets of documents that queries make."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order() -> list[Column]:
    """Highest score first, then by path."""
    return [F.col("score").desc(), F.col("path").asc()]


def top(df: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """The first results; with a limit, no full sort."""
    df = df.orderBy(*in_order())
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit > 0 else df


def reverse(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("score").asc(), F.col("path").desc())


def page(df: DataFrame, number: int, size: int = 20) -> DataFrame:
    """One page of results with their rank; the first page where there is no such page. Pages count from 0.

    One page is the tail of the first (number + 1) * size results, so that nothing is sorted in full.
    """
    number = max(0, number)
    first = top(df, (number + 1) * size)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*in_order())))
    n = first.agg(F.count("*").alias("n_first"))
    start = F.when(F.col("n_first") > number * size, number * size).otherwise(0)
    # the window and the count are over one page's worth of rows at most
    return ranked.crossJoin(F.broadcast(n)).where((F.col("rank") > start) & (F.col("rank") <= start + size)).drop("n_first")


def page_count(total: int, size: int = 20) -> int:
    return -(-total // size)


class Slice(NamedTuple):
    total: int
    returned: int
    truncated: bool
    next_offset: int | None


def window(total: int, offset: int, limit: int) -> Slice:
    """What of all results a slice shows, and where the next one starts."""
    shown = max(0, min(limit, total - offset)) if limit > 0 else max(0, total - offset)
    more = offset + shown < total
    return Slice(total, shown, more, offset + shown if more else None)


def match_hash(content: Column, locations: Column) -> Column:
    """SHA-256 of all matched bytes, by place; empty without places."""
    raw = content.cast("binary")
    size = F.octet_length(raw)
    places = F.array_sort(F.transform(locations, lambda x: F.struct(F.greatest(x["s"], F.lit(0)).alias("s"), F.least(x["e"], size).alias("e"))))
    joined = F.aggregate(places, F.lit(b""), lambda acc, x: F.when(x["s"] < x["e"], F.concat(acc, F.substring(raw, x["s"] + 1, x["e"] - x["s"]))).otherwise(acc))
    return F.when(F.size(locations) > 0, F.sha2(joined, 256)).otherwise(F.lit(""))


def deduplicated(df: DataFrame) -> DataFrame:
    """The first of the results with the same match_hash, with how many more there are; those without a hash all stay.

    Rows are told apart as rows, so that several may have one path. One aggregation by hash, which combines before it shuffles, and
    no window over a hash that many share.
    """
    alone = F.concat(F.lit("row:"), F.monotonically_increasing_id())
    keyed = df.select(F.struct("*").alias("_kept"), F.when(F.col("match_hash") == "", alone).otherwise(F.col("match_hash")).alias("_key"))
    first = F.struct((-F.col("_kept.score")).alias("down"), F.col("_kept.path").alias("path"), *[F.col("_kept._row").alias("row")] * ("_row" in df.columns))
    best = keyed.groupBy("_key").agg(F.min_by("_kept", first).alias("_kept"), (F.count("*") - 1).alias("duplicate_count"))
    return best.select("_kept.*", "duplicate_count")


def duplicate_locations(df: DataFrame) -> DataFrame:
    """match_hash, path, duplicate_of: the other places of what deduplicated() keeps."""
    shared = df.where("match_hash != ''")
    best = shared.groupBy("match_hash").agg(F.min(F.struct((-F.col("score")).alias("down"), F.col("path"))).alias("best"))
    return shared.join(best, "match_hash").where("path != best.path").select("match_hash", "path", F.col("best.path").alias("duplicate_of"))


def facets(df: DataFrame, column: str = "extension") -> DataFrame:
    """How many results each value has, most first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column).asc())


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of either, once for each path."""
    return a.unionByName(b).dropDuplicates(["path"])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("path"), "path", "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("path"), "path", "left_semi")
