"""Near-duplicate documents by SetSketch registers.

Each text's set of word shingles becomes REGISTERS registers: truncated minima of exponential hashes on a scale of powers of
BASE, which merge by maximum and agree the more often the more two sets share. Equal sets are one class. Bands of ROWS registers
deal classes into buckets. Within a bucket every class meets the leader, the class with most copies; their Jaccard
similarity is estimated jointly by likelihood from registers and set sizes, and what may reach the threshold is verified on the full
sets. Where that leaves a bucket with several components, their classes meet in blocks, by registers. Components with classes
that may be linked form a family, and within a family classes of different components meet in blocks, by full sets.

No pairs are listed within a bucket or a family: meeting the leader is one row for each member, and blocks compare in memory and
give only pairs that join components. A block holds BLOCK rows of each side at most; a bucket of any size is as many blocks as it needs,
and classes already in the leader's component don't meet each other.

Links of similarity 0.8 share a bucket but for one in 10^7, and the estimate refuses one in 10^6; what is linked is exact.
Shingles are compared by 64-bit hashes.

Defined results: words are runs without ASCII white space, ASCII letters lower-cased; a text with fewer words than a
shingle has the whole sequence as its one shingle; a null text or one without words has the empty set and is
linked with nothing; repeated rows of a doc_id have the same component. Classes are known by their sets, so rows with a null doc_id,
or different texts with the same one, are linked as others are; a component's id is the smallest doc_id there is in it, null if there
is none. kept is true for the rows of one doc_id (or null) and set in a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import dropped, emitted, prepare, rows, shared_dir, table, texts, written
from textloom.llm.components import components

REGISTERS, BANDS, ROWS = 128, 32, 4
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Words of a shingle, and the least similarity in hundredths.
WORDS, LEAST = 5, 80
#: How far below the threshold an estimate may lie, in its standard deviations.
DOUBT = 5.0
BLOCK, SHINGLES = 512, 500_000
#: Pairs that are looked at in one go, and whose registers are.
PAIRS, CHUNK = 1 << 18, 1 << 13
#: Most ids that are sent to all executors; more are joined by shuffling.
MOST_IDS = 2_000_000
MEMO = 400_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(20250311)
_ODD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_TURN = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_CHUNK = 512
_buffer = np.empty((_CHUNK, REGISTERS), np.uint32)


class _Hashes(dict):
    """Hashes of words; forgets when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    found = text.translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        total += h[i : len(h) - size + 1 + i] * _TURN[i]
    return np.unique(_mixed(total))


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes; all 0 for the empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), _CHUNK):
        part = high[i : i + _CHUNK]
        v = np.multiply(part[:, None], _ODD, out=_buffer[: len(part)])
        v += _ADD
        np.minimum(least, v.min(axis=0), out=least)
    x = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def likely_similarity(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood, given how many registers of a exceed or fall below b's, and set sizes."""
    more, less, n_a, n_b = (np.asarray(x, float) for x in (more, less, n_a, n_b))
    same = REGISTERS - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    above = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = above(u - v * j), above(v - u * j)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(np.shape(u)), np.minimum(u / v, v / u)
    for _ in range(25):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) < likelihood(b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2


def doubtful(least: int) -> float:
    """The estimate from which a pair is verified."""
    j = least / 100
    return j - DOUBT * (j * (1 - j) / REGISTERS) ** 0.5


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sorted sets have 100 * intersection >= least * union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= least * (len(both) - common)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set of shingles."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(a), int(b)


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("registers", pa.binary())])


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, registers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text in rows(b, doc_id=pa.int64(), text=pa.binary()):
                    s = shingles(text, words)
                    yield doc_id, len(s), *_set_key(s), registers(s).tobytes()

        return emitted(SKETCH, found())

    return texts(docs).mapInArrow(each, "doc_id long, n_shingles long, set_a long, set_b long, registers binary")


def _sets(docs: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """id, n, registers, set of the classes in a written table (id, first, set_a, set_b), from the texts of their first doc_ids."""
    hint = F.broadcast if named.count() <= MOST_IDS else lambda df: df
    docs = texts(docs)
    chosen = docs.join(hint(named.where("first is not null").select(F.col("first").alias("doc_id")).distinct()), "doc_id", "left_semi")
    if not named.where("first is null").isEmpty():
        chosen = chosen.unionByName(docs.where("doc_id is null"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("set_a", pa.int64()), ("set_b", pa.int64()), ("n", pa.int64()), ("registers", pa.binary()), ("set", pa.binary())])

        def found() -> Iterator[tuple]:
            for b in batches:
                for (text,) in rows(b, text=pa.binary()):
                    s = shingles(text, words)
                    yield *_set_key(s), len(s), registers(s).tobytes(), s.tobytes()

        return emitted(schema, found())

    made = chosen.mapInArrow(each, "set_a long, set_b long, n long, registers binary, set binary").dropDuplicates(["set_a", "set_b"])
    return made.join(hint(named.select("id", "set_a", "set_b")), ["set_a", "set_b"]).select("id", "n", "registers", "set")


def _verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that are linked: first by the estimate, then by their sets."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}"), F.col("set").alias(f"s_{side}")), side)
        if side == "b":
            pairs = pairs.where(100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    floor = doubtful(least)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            regs = [np.frombuffer(b"".join(batch.column(f"r_{s}").to_pylist()), np.uint16).reshape(n, REGISTERS) for s in "ab"]
            sizes = [batch.column(f"n_{s}").to_numpy(zero_copy_only=False) for s in "ab"]
            likely = likely_similarity((regs[0] > regs[1]).sum(1), (regs[0] < regs[1]).sum(1), *sizes) >= floor
            got = []
            for i in np.flatnonzero(likely).tolist():
                sa, sb = (np.frombuffer(batch.column(f"s_{s}")[i].as_py(), np.uint64) for s in "ab")
                if linked(sa, sb, least):
                    got.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(s).take(pa.array(got, pa.int64())) for s in "ab"], schema=schema)

    return pairs.mapInArrow(each, "a long, b long")


class _Rows(NamedTuple):
    """Rows of whole blocks: which component and side, the set's size, its registers or shingles, and where each block starts."""

    comp: np.ndarray
    side: np.ndarray
    n: np.ndarray
    value: list[bytes]
    starts: np.ndarray

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Of each block, rows of the smaller and of the larger side; where there is one side, its rows twice and True."""
        for s, e in zip(self.starts.tolist(), [*self.starts[1:].tolist(), len(self.comp)], strict=True):
            side = self.side[s:e]
            a, b = np.flatnonzero(side == 0) + s, np.flatnonzero(side == 1) + s
            if not len(a) or not len(b):
                a = a if len(a) else b
                yield a, a, True
            else:
                yield (a, b, False) if len(a) <= len(b) else (b, a, False)


class _Forest:
    """Which components a task has joined so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (up := p.get(x, x)) != x:
            p[x] = x = p.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _by_block(blocks: DataFrame, value: str, pairs: Callable[[_Rows], Iterator[np.ndarray]]) -> DataFrame:
    """Pairs (a, b) that join all components that a function joins, from rows (key, x, y, side, comp, n, value), block by block.

    Blocks are brought together by a sort and cut out of Arrow batches, many small ones at once; a block that a batch ends in is carried
    on. A task gives a pair only if it joins what none before has, and what is joined isn't compared again: it gives fewer pairs
    than it has components.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ["key", "x", "y", "side", "comp", "n"]

    def made(ints: np.ndarray, values: list[bytes], starts: np.ndarray, forest: _Forest) -> Iterator[pa.RecordBatch]:
        comp = np.fromiter(map(forest.root, ints[4].tolist()), np.int64, ints.shape[1])
        got = []
        for found in pairs(_Rows(comp, ints[3], ints[5], values, starts)):
            got += [p for p in np.unique(np.sort(found, axis=1), axis=0).tolist() if forest.join(*p)]
        if got:
            a, b = np.array(got, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        held, held_values = np.zeros((6, 0), np.int64), []
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            ints, values = np.concatenate([held, own], axis=1), held_values + batch.column(value).to_pylist()
            new = np.flatnonzero((ints[:3, 1:] != ints[:3, :-1]).any(axis=0)) + 1
            if len(new):
                yield from made(ints[:, : new[-1]], values[: new[-1]], np.append([0], new[:-1]), forest)
                ints, values = ints[:, new[-1] :], values[new[-1] :]
            held, held_values = ints, values
        if held_values:
            yield from made(held, held_values, np.zeros(1, np.int64), forest)

    dealt = blocks.select(*names, value).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(each, "a long, b long").distinct()


def _index_pairs(rows: _Rows) -> Iterator[np.ndarray]:
    """Pairs of rows (2 x n) that meet in a block, in portions of bounded size."""
    held, size = [], 0
    for left, right, alone in rows.blocks():
        step = max(1, PAIRS // len(right))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            i, j = np.repeat(part, len(right)), np.tile(right, len(part))
            if alone:
                i, j = i[i < j], j[i < j]
            held.append(np.stack([i, j]))
            size += len(i)
            if size >= PAIRS:
                yield np.concatenate(held, axis=1)
                held, size = [], 0
    if size:
        yield np.concatenate(held, axis=1)


def _likely_components(blocks: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of components that have classes in a common bucket whose estimate can't refuse them."""
    floor = doubtful(least)
    same_at_least = int(REGISTERS * (floor - 2 * (0.25 / REGISTERS) ** 0.5))

    def pairs(rows: _Rows) -> Iterator[np.ndarray]:
        regs = np.frombuffer(b"".join(rows.value), np.uint16).reshape(-1, REGISTERS)
        comp, n = rows.comp, rows.n
        for i, j in _index_pairs(rows):
            near = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]))
            i, j = i[near], j[near]
            for at in range(0, len(i), CHUNK):
                p, q = i[at : at + CHUNK], j[at : at + CHUNK]
                near = np.count_nonzero(regs[p] == regs[q], axis=1) >= same_at_least
                p, q = p[near], q[near]
                if len(p):
                    likely = likely_similarity((regs[p] > regs[q]).sum(1), (regs[p] < regs[q]).sum(1), n[p], n[q]) >= floor
                    yield np.stack([comp[p[likely]], comp[q[likely]]], 1)

    return _by_block(blocks, "registers", pairs)


def _linked_components(blocks: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of components with classes that are linked, by full sets.

    One side's sets are indexed by shingle, so that a set of the other side meets all of them at once.
    """

    def pairs(rows: _Rows) -> Iterator[np.ndarray]:
        comp, n = rows.comp, rows.n
        sets = [np.frombuffer(x, np.uint64) for x in rows.value]
        for left, right, _ in rows.blocks():
            owners = np.repeat(np.arange(len(right)), n[right])
            flat = np.concatenate([sets[j] for j in right])
            order = np.argsort(flat, kind="stable")
            known, first = np.unique(flat[order], return_index=True)
            owners, last = owners[order], np.append(first[1:], len(flat))
            right_comp, right_n = comp[right], n[right]
            for i in left.tolist():
                at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
                at = at[known[at] == sets[i]]
                if not len(at):
                    continue
                sizes = last[at] - first[at]
                take = np.repeat(first[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                common = np.bincount(owners[take], minlength=len(right))
                hit = (100 * common >= least * (n[i] + right_n - common)) & (right_comp != comp[i])
                if hit.any():
                    others = np.unique(right_comp[hit])
                    yield np.stack([np.full(len(others), comp[i]), others], 1)

    return _by_block(blocks, "set", pairs)


def _dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (key, x, y, side, id, comp) of members (key, id, comp, n, core), and a written table to drop afterwards.

    Core rows, of one component, meet the rest; the rest meet each other. Chunks are so many that none has more than about BLOCK rows or SHINGLES
    shingles.
    """
    chunks = lambda which: F.greatest(F.ceil(F.sum(which.cast("long")) / BLOCK), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / SHINGLES)).cast("int")
    counts = members.groupBy("key").agg(chunks(F.col("core")).alias("g_core"), chunks(~F.col("core")).alias("g_rest")).where("g_rest > 0 and not (g_core = 0 and g_rest = 0)")
    counts = written(counts, "mixed")
    mixed = members.join(counts, "key")
    draw = lambda g: F.pmod(F.xxhash64("id"), g).cast("int")
    # a chunk of the core stands against each chunk of the rest: x < 0 marks it
    core = mixed.where("core").select("key", (-1 - draw(F.col("g_core"))).alias("x"), F.explode(F.sequence(F.lit(0), F.col("g_rest") - 1)).alias("y"), F.lit(0).alias("side"), "id", "comp")
    rest = mixed.where("not core").withColumn("c", draw(F.col("g_rest")))
    to_core = rest.where("g_core > 0").select("key", F.explode(F.sequence(-F.col("g_core"), F.lit(-1))).alias("x"), F.col("c").alias("y"), F.lit(1).alias("side"), "id", "comp")
    each_other = rest.select("key", "c", F.explode(F.sequence(F.lit(0), F.col("g_rest") - 1)).alias("d"), "id", "comp")
    each_other = each_other.select("key", F.least("c", "d").alias("x"), F.greatest("c", "d").alias("y"), F.when(F.col("c") <= F.col("d"), 0).otherwise(1).alias("side"), "id", "comp")
    return core.unionByName(to_core).unionByName(each_other), counts


def _of(roots: DataFrame, column: str, to: str) -> DataFrame:
    return roots.select(F.col("node").alias(column), F.col("root").alias(to))


def _bucket_members(members: DataFrame, leaders: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, id, comp, n, core) of the buckets that hold several components; core is the leader's."""
    members = members.join(_of(roots, "id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")).join(sizes, "id")
    leaders = leaders.join(_of(roots, "leader", "top"), "leader", "left").select("key", F.coalesce("top", "leader").alias("top"))
    return written(members.join(leaders, "key").select("key", "id", "comp", "n", (F.col("comp") == F.col("top")).alias("core")), "members")


def _family_members(pairs: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, id, comp, n, core) of the components in pairs; the key is the family, core its largest component."""
    families = components(pairs)
    named = families.select(F.col("node").alias("comp"), F.col("root").alias("key")).unionByName(families.select(F.col("root").alias("comp"), F.col("root").alias("key")).distinct())
    rows = sizes.join(_of(roots, "id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")).join(named, "comp")
    largest = rows.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("top")).select("key", F.col("top.comp").alias("top"))
    out = written(rows.join(largest, "key").select("key", "id", "comp", "n", (F.col("comp") == F.col("top")).alias("core")), "family")
    dropped(pairs.sparkSession, families)
    return out


def classes(sketched: DataFrame) -> DataFrame:
    """id (a number of its own, once written), set_a, set_b, first (the smallest doc_id, if any), copies, registers of each distinct nonempty set."""
    found = sketched.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.any_value("registers").alias("registers"))
    return found.select(F.monotonically_increasing_id().alias("id"), "set_a", "set_b", "first", "copies", "registers")


def near_duplicates(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    return _decided(docs, words, least).select("doc_id", "n_shingles", "component_id", "kept")


def _decided(docs: DataFrame, words: int, least: int) -> DataFrame:
    """The rows of near_duplicates with set_a and set_b."""
    spark = docs.sparkSession
    prepare(spark)
    shared_dir(spark)
    sketched = written(sketches(docs, words), "sketches")
    ids = written(classes(sketched), "classes")
    width = 2 * ROWS
    bands = ids.select("id", "copies", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.substring("registers", j * width + 1, F.lit(width)))).alias("band", "part"))
    bands = bands.select(F.xxhash64("band", "part").alias("key"), "id", (-F.col("copies")).alias("down"))
    leaders = bands.groupBy("key").agg(F.min(F.struct("down", "id")).alias("top"), F.count("*").alias("n")).where("n > 1")
    leaders = written(leaders.select("key", F.col("top.id").alias("leader"), F.col("top.down").alias("down")), "leaders")
    members = written(bands.select("key", "id").join(leaders, "key"), "bucketed")
    named = written(ids.select("id", "first", "set_a", "set_b").join(members.select("id"), "id", "left_semi"), "named")
    sets = written(_sets(docs, named, words), "sets")
    sizes = sets.select("id", "n")
    # each class meets the best of its leaders, and then those of other components
    meets = members.where("id != leader")
    best = meets.groupBy(F.col("id").alias("b")).agg(F.min(F.struct("down", "leader")).alias("top")).select(F.col("top.leader").alias("a"), "b")
    first = written(_verified(best, sets, least), "first")
    roots = components(first)
    more = meets.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct().join(_of(roots, "a", "root_a"), "a", "left").join(_of(roots, "b", "root_b"), "b", "left")
    more = more.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    second = written(_verified(more, sets, least), "second")
    roots = components(second, roots)
    in_buckets = _bucket_members(members.select("key", "id"), leaders.select("key", "leader"), roots, sizes)
    blocks, mixed = _dealt(in_buckets)
    pairs = written(_likely_components(blocks.join(sets.select("id", "n", "registers"), "id"), least), "pairs")
    in_families = _family_members(pairs, roots, sizes)
    blocks, mixed_families = _dealt(in_families)
    third = written(_linked_components(blocks.join(sets.select("id", "n", "set"), "id"), least), "third")
    roots = components(third, roots)
    dropped(spark, leaders, members, named, sets, first, second, in_buckets, mixed, pairs, in_families, mixed_families, third)
    # back to rows: by class, then by set; a component is named by its smallest doc_id, and the class that has it stays
    top = written(ids.select("id", "first", "set_a", "set_b").join(_of(roots, "id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "top")
    best = top.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "id")).alias("best"))
    by_set = written(top.join(best, "root").select("set_a", "set_b", F.col("best.first").alias("component"), (F.col("best.id") == F.col("id")).alias("chosen")), "by_set")
    dropped(spark, ids, top)
    out = sketched.select("doc_id", "n_shingles", "set_a", "set_b").join(by_set, ["set_a", "set_b"], "left")
    out = out.withColumn("component_id", F.when(F.col("chosen").isNull(), F.col("doc_id")).otherwise(F.col("component")))
    kept = F.coalesce("chosen", F.lit(True)) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "set_a", "set_b")


def _keyed(docs: DataFrame, words: int) -> DataFrame:
    """docs with _nd_a and _nd_b, the hash of the text's set, and _nd_blank, the text where that set is empty."""

    @F.pandas_udf("n long, a long, b long")
    def key(text: pd.Series) -> pd.DataFrame:
        found = [shingles(t, words) for t in text]
        return pd.DataFrame([(len(s), *_set_key(s)) for s in found], columns=["n", "a", "b"])

    text = F.col("text").cast("string")
    docs = docs.withColumn("_nd", key(F.coalesce(text, F.lit("")).cast("binary")))
    return docs.select("*", F.col("_nd.a").alias("_nd_a"), F.col("_nd.b").alias("_nd_b"), F.when(F.col("_nd.n") == 0, text).alias("_nd_blank"))


def one_of_each(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The rows of docs that stay: one document for each group of near-duplicates, and one row of repeated rows.

    Rows are repeats if they have the same doc_id (or none) and the same set of shingles; where that is empty, the same text. Texts
    are shuffled only if more ids go than may be sent to all executors, and those of rows without an id of their own.
    """
    found = written(_decided(docs, words, least).select("doc_id", "kept", "set_a", "set_b"), "found")
    again = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"), F.lit(True).alias("_is")), "again")
    n = again.count()
    hint = F.broadcast if n <= MOST_IDS else lambda df: df
    gone = written(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).join(hint(again), F.col("_gone") == F.col("_again"), "left_anti"), "gone")
    few = gone.count() <= MOST_IDS
    same = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == F.col("_gone"), "left_anti")
    if not n and found.where("doc_id is null").isEmpty():
        return same
    marked = same.join(hint(again), docs["doc_id"] == F.col("_again"), "left")
    shared = F.col("_is").isNotNull() | F.col("doc_id").isNull()
    decided = found.where("kept").select(F.col("doc_id").alias("_of"), F.col("set_a").alias("_set_a"), F.col("set_b").alias("_set_b"))
    named = decided.join(hint(again), F.col("_of") == F.col("_again"), "left_semi").unionByName(decided.where("_of is null"))
    more = _keyed(marked.where(shared), words)
    more = more.join(named, more["doc_id"].eqNullSafe(F.col("_of")) & (more["_nd_a"] == F.col("_set_a")) & (more["_nd_b"] == F.col("_set_b")), "left_semi")
    more = more.dropDuplicates(["doc_id", "_nd_a", "_nd_b", "_nd_blank"])
    return marked.where(~shared).select(*docs.columns).unionByName(more.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s
  FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM shingled
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM shingled
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, cast(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM shingled JOIN least USING (doc_id)
"""
