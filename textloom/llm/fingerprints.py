"""Order MinHash: fingerprints of whole texts that follow the edit distance.

A text becomes its k-mers of code points, each numbered by its occurrence, so that repeats count. For each of
SKETCHES hash functions the LENGTH smallest numbered k-mers are taken, put back in text order and hashed to one
32-bit value. Two texts agree in a value if they share those k-mers in that order; the share of agreeing values is
their likeness.

Defined results: a null text counts as empty; the empty text has a fingerprint of its own, like itself and no other;
a text shorter than K is one k-mer; fewer than LENGTH k-mers are hashed as they are; equal texts have equal
fingerprints; a null doc_id sorts first; repeated doc_ids sort by their text's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import emitted, rows, table, texts

K, SKETCHES, LENGTH = 16, 40, 2
#: Documents of one run of neighbours, and the most runs; both only shape the work.
RUN_ROWS, MOST_RUNS = 1000, 20_000
#: Expected candidates for the LENGTH smallest of a sketch; a sketch that finds fewer than LENGTH is done in full.
CANDIDATES, BLOCK = 12, 1024

_rng = np.random.default_rng(20240607)
_ODD = _rng.integers(0, 1 << 32, SKETCHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SKETCHES, dtype=np.uint32)
#: Reused for each block, so that none is allocated anew.
_buffers = np.empty(SKETCHES * BLOCK, np.uint32), np.empty(SKETCHES * BLOCK, bool)
EMPTY = np.full(SKETCHES, 0xFFFFFFFF, np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def numbered_kmers(codes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (k-mer, occurrence) and their positions, ordered by k-mer and position."""
    h = codes.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)
    width, step = min(k, len(codes)), 1
    while 2 * step <= width:
        h = _mixed(h[:-step] * np.uint32(0x01000193) + h[step:])
        step *= 2
    if step < width:
        h = _mixed(h[: step - width] * np.uint32(0x01000193) + h[width - step :])
    key = np.sort((h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64))
    h, at = (key >> np.uint64(32)).astype(np.uint32), key.astype(np.uint32)
    index = np.arange(len(h))
    start = np.zeros(len(h), np.int64)
    new = np.flatnonzero(h[1:] != h[:-1]) + 1
    start[new] = new
    occurrence = index - np.maximum.accumulate(start)
    return _mixed(h + occurrence.astype(np.uint32) * np.uint32(0x9E3779B9)), at


def fingerprint(text: str, k: int = K) -> np.ndarray:
    """SKETCHES values for a text."""
    if not text:
        return EMPTY
    h, at = numbered_kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), k)
    n = len(h)
    below = np.uint32(min(0xFFFFFFFF, CANDIDATES * (1 << 32) // n))
    found: list[np.ndarray] = []
    values, small = _buffers
    for i in range(0, n, BLOCK):
        part = h[i : i + BLOCK]
        v = np.multiply(part, _ODD[:, None], out=values[: SKETCHES * len(part)].reshape(SKETCHES, len(part)))
        v += _ADD[:, None]
        flat = np.flatnonzero(np.less_equal(v, below, out=small[: v.size].reshape(v.shape)))
        row, col = np.divmod(flat, len(part))
        found.append(np.stack([row.astype(np.uint64), v.ravel()[flat].astype(np.uint64), (col + i).astype(np.uint64)]))
    row, v, col = np.concatenate(found, axis=1) if len(found) > 1 else found[0]
    order = np.lexsort((at[col.astype(np.int64)], (row << np.uint64(32)) | v))
    row, col = row[order].astype(np.int64), col[order].astype(np.int64)
    first = np.searchsorted(row, np.arange(SKETCHES + 1))
    size = min(LENGTH, n)
    picked = np.empty((SKETCHES, size), np.int64)
    enough = np.diff(first) >= size
    picked[enough] = col[first[:-1][enough, None] + np.arange(size)]
    for j in np.flatnonzero(~enough):
        picked[j] = np.lexsort((at, h * _ODD[j] + _ADD[j]))[:size]
    picked = np.take_along_axis(picked, np.argsort(at[picked], axis=1), axis=1)
    out = np.full(SKETCHES, size, np.uint32)
    for i in range(size):
        out = _mixed(out * np.uint32(0x01000193) + h[picked[:, i]])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def text_of(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def runs(docs: DataFrame) -> DataFrame:
    """Documents dealt into runs of neighbouring doc_ids, each followed by the first document of the next run.

    Run borders are quantiles of doc_id: one scan of that column and a list of at most MOST_RUNS numbers. The
    column `ahead` marks the document that a run borrows.
    """
    spark = docs.sparkSession
    n = docs.count()
    count = max(1, min(MOST_RUNS, -(-n // RUN_ROWS)))
    cuts = []
    if count > 1:
        cuts = sorted(set(docs.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.2 / count)))
    run = F.lit(0)
    if cuts:
        run = F.coalesce(_rank(F.col("doc_id"), F.lit([int(c) for c in cuts]), len(cuts)), F.lit(0))
    docs = docs.select(run.cast("int").alias("run"), F.lit(False).alias("ahead"), "doc_id", "text")
    firsts = docs.groupBy("run").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).sort("run").collect()
    following = [(r.run, None if firsts[0].nulls and j == 0 else firsts[j].first) for i, r in enumerate(firsts) for j in [(i + 1) % len(firsts)]]
    ids = spark.createDataFrame(following, "into int, first long")
    ahead = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("into").alias("run"), F.lit(True).alias("ahead"), "doc_id", "text")
    return docs.unionByName(ahead).repartition("run").sortWithinPartitions("run", "ahead", "doc_id", F.xxhash64("text"))


def _rank(value: Column, borders: Column, n: int) -> Column:
    """How many of the n sorted borders are at most value, by bisection."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(borders, low + step - 1) <= value), low + step).otherwise(low))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple]:
        before = None
        for b in batches:
            for run, ahead, doc_id, text in rows(b, run=pa.int32(), ahead=pa.bool_(), doc_id=pa.int64(), text=pa.string()):
                if before and (before[0], before[1]) == (run, True):
                    continue  # the borrowed document's repeats
                prints = fingerprint(text)
                if before and not before[1]:
                    yield row(before, text, prints)
                before = (run, ahead, doc_id, text, prints)

    def row(before: tuple, text: str, prints: np.ndarray) -> tuple:
        _, _, doc_id, own, own_prints = before
        changed = edited(own, text)
        changed_prints = fingerprint(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(own), digest, text_of(own_prints), text_of(changed_prints), likeness(own_prints, changed_prints), likeness(own_prints, prints)

    return emitted(SCHEMA, found())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint for each document; no shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])
        return emitted(schema, ((i, len(t), text_of(fingerprint(t))) for b in batches for i, t in rows(b, doc_id=pa.int64(), text=pa.string())))

    return texts(docs).mapInArrow(each, "doc_id long, n_chars long, fingerprint string")


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside its edited text's and the next document's; one shuffle of the texts."""
    return runs(texts(docs)).mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
