"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share all words by weight, none above MOST times its source's size. Equal blocks of words are the seats: they
go to sources by the highest quotients target / (2 * seats + 1), then in the same way, by size, to the shards of each
source, which gives an integer quota for each shard. A shard's documents, end to end in a seeded order, are its blocks,
of BLOCK words each and in that order. Whole rounds take all of them; the blocks that are left of the quota are the leading ones. Since
the order is drawn by document, blocks of one document stand together and at most one document of a shard is taken in part.

A source's documents are dealt to shards by a seeded hash, so that a source with a third of all rows is as many groups
as its rows need; only sums by shard reach the driver, at most MOST_SHARDS and one for each source. They come back as
a broadcast up to MOST_GIVEN rows, and by a join that deals both sides by shard beyond that.

Defined results: a null text has no words and none are taken; a null source is a source, last in order; repeated rows
are dealt alike and ordered by their text's hash; no rows give no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import prepare, table

WORD = r"[^\x20\x09-\x0D]+"
MOST, BLOCK, SEED = 3, 16, 7
SHARD_ROWS, MOST_SHARDS, MOST_GIVEN = 1000, 20_000, 50_000


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weights(count: int) -> list[int]:
    return [1 + i % 3 for i in range(count)]


def targets(sizes: list[int], by: list[float]) -> list[float]:
    """Shares of the sum of sizes by weight; none above MOST times its size, what is over shared again."""
    capped: set[int] = set()
    total = sum(sizes)
    while True:
        left = total - sum(MOST * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(by) if i not in capped)
        out = [float(MOST * s) if i in capped else left * by[i] / weight for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and out[i] > MOST * s}
        if not over:
            return out
        capped |= over


def apportion(votes: list[float], seats: int) -> list[int]:
    """Sainte-Lague seats: the highest quotients votes / (2 * seats + 1) win; ties go to the earlier.

    Seats that every divisor near the last quotient would give are set at once, so the cost follows the number of
    claimants, not of seats.
    """
    total = sum(votes)
    if not votes or total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [max(0, int(v / total * seats - 0.5)) for v in votes]
    while sum(got) > seats:
        i = max((i for i in range(len(got)) if got[i]), key=lambda i: (-votes[i] / (2 * got[i] - 1), i))
        got[i] -= 1
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def quotas(cells: list[tuple], block: int = BLOCK) -> list[tuple]:
    """From (source, shard, size), rows (source, shard, source_size, target, quota), quotas in words."""
    by: dict = {}
    for source, shard, size in cells:
        by.setdefault(source, []).append((shard, size))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    sizes = [sum(n for _, n in by[s]) for s in order]
    aims = targets(sizes, weights(len(order))) if sum(sizes) else [0.0] * len(order)
    out = []
    for source, size, aim, seats in zip(order, sizes, aims, apportion(aims, round(sum(sizes) / block)), strict=True):
        shards = sorted(by[source])
        for (shard, n), q in zip(shards, apportion([float(n) for _, n in shards], seats), strict=True):
            out.append((source, shard, size, aim, min(q * block, MOST * n)))
    return out


def mix(docs: DataFrame, *keep: str, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the columns to keep) for each document.

    Two scans, one shuffle of narrow rows by shard (of the columns kept too, where any are).
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.count()
    per_shard = max(SHARD_ROWS, -(-rows // MOST_SHARDS))
    per_source = docs.groupBy(F.col("source").cast("string").alias("source")).count().collect()
    dealt = {r.source: max(1, -(-r["count"] // per_shard)) for r in per_source}
    # one number for each source that has more than one shard: at most MOST_SHARDS entries
    many = {k: v for k, v in dealt.items() if v > 1}
    count = F.lit(1)
    if many:
        named = {k: v for k, v in many.items() if k is not None}
        if named:
            count = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("source")), F.lit(1))
        if None in many:
            count = F.when(F.col("source").isNull(), many[None]).otherwise(count)
    docs = docs.select(*keep, "doc_id", F.col("source").cast("string").alias("source"), words("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("_drawn"), F.xxhash64("text").alias("_text"))
    docs = docs.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), count).cast("int"))
    cells = [tuple(r) for r in docs.groupBy("source", "_shard").agg(F.sum("size")).collect()]
    given = spark.createDataFrame(quotas(cells), "_source string, _cell int, source_size long, target double, _quota long")
    # one row for each shard: at most MOST_SHARDS and the number of sources
    given = F.broadcast(given) if len(cells) <= MOST_GIVEN else given.hint("merge")
    docs = docs.join(given, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_cell")))
    w = Window.partitionBy("source", "_shard").orderBy("_drawn", "doc_id", "_text")
    docs = docs.withColumn("_cell_size", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    docs = docs.withColumn("_before", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    one = F.greatest(F.col("_cell_size"), F.lit(1))
    rounds, rest = F.expr("_quota div greatest(_cell_size, 1)"), F.col("_quota") % one
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return docs.select(*keep, *[c for c in ("doc_id",) if c not in keep], "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))


def taken_rows(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each whole copy, and one with the text's first words for a part of one.

    The same columns; n_chars, where there is one, is counted again for the parts. A text without words is not taken.
    """
    names = docs.columns
    inner = docs.select(F.col("doc_id"), F.col("source"), F.col("text"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"))
    got = mix(inner, "_row").where("taken > 0")
    got = got.select("_row", "size", "taken", F.explode(F.expr("sequence(1L, cast(ceil(taken / size) as bigint))")).alias("_copy"))
    words_left = F.least(F.col("size"), F.col("taken") - (F.col("_copy") - 1) * F.col("size"))
    text = F.col("_row.text").cast("string")
    # the word numbered words_left ends where the text without its first words_left words begins
    shown = F.when(words_left == F.col("size"), text).otherwise(_leading(text, words_left))
    out = []
    for n in names:
        if n == "text":
            out.append(shown.alias(n))
        elif n == "n_chars":
            out.append(F.when(words_left == F.col("size"), F.col("_row.n_chars")).otherwise(F.char_length(shown)).cast(docs.schema[n].dataType).alias(n))
        else:
            out.append(F.col(f"_row.`{n}`").alias(n))
    return got.select(*out)


def _leading(text: Column, count: Column) -> Column:
    """A text's first words, with the white space before and between them."""
    gaps = F.split(text, WORD, -1)
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    head = F.zip_with(F.slice(gaps, 1, count.cast("int")), F.slice(found, 1, count.cast("int")), lambda a, b: F.concat(a, b))
    return F.array_join(head, "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
