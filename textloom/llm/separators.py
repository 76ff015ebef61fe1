"""Token counts of documents in flat token files, found by their end-of-document ids.

A flat file is unsigned 16-bit ids without an index, each document followed by the end id. It is read in ranges of
fixed length, by offset, that know nothing of documents. Each range is searched with vector operations for end ids and gives its
own documents' positions, its token count and its last end id; a prefix scan over those few numbers (running sums and
maxima by file) puts ranges in place and stitches the documents that cross borders.

Files are opened where they lie by Python's workers: a folder that all share, or what pyarrow opens by its address. A task that
is done again writes a file of its own; only files that a finished task names are read.

Defined results: a null or empty text is a document of no tokens; tokens after the last end id of a file are no
document; an empty file has none; ranges of any length, even of one id, give the same counts. A string that names the end id is
ordinary text; a vocabulary with ids above 65,535 is refused.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import batch, emitted, new_folder, prepare, rows, table, texts, written
from textloom.llm.tokens import END_OF_TEXT, encoder

BLOCK_TOKENS = 1 << 16
#: Blocks of one group of the prefix scan; groups are scanned themselves, so that a file of any length is spread.
GROUP = 1024
#: Bytes that one task reads, and ids that are held before they are written.
TASK_BYTES, HELD = 32 << 20, 1 << 20
NAMES = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    local = re.fullmatch(r"(?:file:/*)?(/?.*)", address) if re.match(r"file:|[^:]*$", address) else None
    return (fs.LocalFileSystem(), "/" + local[1].lstrip("/")) if local else fs.FileSystem.from_uri(address)


def flat_files(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Writes a flat file for each partition, and gives rows (file, ordinal, doc_id) that say which document stands where: for
    results only, the scan doesn't see them. Files are written once these rows are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.bin"
        encode = encoder(path, special=False)
        system, at = _opened(folder)

        def found() -> Iterator[tuple]:
            end = np.array([END_OF_TEXT], "<u2")
            held, size, ordinal = [], 0, 0
            with system.open_output_stream(f"{at}/{name}") as out:
                for b in batches:
                    for doc_id, text in rows(b, doc_id=pa.int64(), text=pa.string()):
                        ids = encode(text)
                        if len(ids) and ids.max() > 0xFFFF:
                            raise ValueError("the vocabulary has ids that 16 bits don't hold")
                        held += [ids.astype("<u2"), end]
                        size += len(ids) + 1
                        if size >= HELD:
                            out.write(np.concatenate(held).tobytes())
                            held, size = [], 0
                        yield name, ordinal, doc_id
                        ordinal += 1
                if held:
                    out.write(np.concatenate(held).tobytes())

        return emitted(NAMES, found())

    return texts(docs).mapInArrow(each, "file string, ordinal long, doc_id long")


def read_blocks(spark: SparkSession, folder: str, block: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, ids) of the flat files in a folder, each read by its offset and length."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    width = 2 * block
    ranges = files.where("length > 0").select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {width})")).alias("block"))
    # a task reads some neighbouring blocks of a file
    together = max(1, TASK_BYTES // (4 * width))
    parts = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = ranges.repartition(parts, "path", F.expr(f"block div {together}"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ids", pa.binary())])

        def found() -> Iterator[tuple]:
            last, opened = None, None
            for b in batches:
                for path, length, number in rows(b, path=pa.string(), length=pa.int64(), block=pa.int64()):
                    if path != last:
                        if opened:
                            opened.close()
                        system, at = _opened(path)
                        last, opened = path, system.open_input_file(at)
                    yield path.rsplit("/", 1)[-1], number, opened.read_at(min(width, length - number * width), number * width)
            if opened:
                opened.close()

        return emitted(schema, found())

    return ranges.mapInArrow(each, "file string, block long, ids binary")


def scan(blocks: DataFrame, end: int = END_OF_TEXT) -> DataFrame:
    """file, ordinal, start, n_tokens of each document, from blocks (file, block, ids)."""
    prepare(blocks.sparkSession)
    kind = blocks.schema["file"].dataType.simpleString()
    blocks = blocks.select("file", "block", "ids")
    file_type = pa.string() if kind == "string" else pa.int64()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", file_type), ("block", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int32()))])
        for b in batches:
            got = []
            for file, block, ids in rows(b, file=file_type, block=pa.int64(), ids=pa.binary()):
                flat = np.frombuffer(ids, "<u2")
                got.append((file, block, len(flat), np.flatnonzero(flat == end).astype(np.int32)))
            yield batch(schema, got)

    found = blocks.mapInArrow(each, f"file {kind}, block long, size long, ends array<int>")
    found = found.select("*", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"), F.expr(f"block div {GROUP}").alias("group"))
    # the scan: within a group of blocks, then over groups
    inner = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select("file", "group", "ends", F.coalesce(F.sum("size").over(inner), F.lit(0)).alias("at"), F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("seen"), "size", "n", "last")
    here = Window.partitionBy("file", "group").orderBy("at", "seen").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("open", F.max(F.col("at") + F.col("last")).over(here))
    outer = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = found.groupBy("file", "group").agg(F.sum("size").alias("gs"), F.sum("n").alias("gn"), F.max(F.col("at") + F.col("last")).alias("gl"))
    groups = groups.select("file", "group", F.coalesce(F.sum("gs").over(outer), F.lit(0)).alias("g_at"), F.coalesce(F.sum("gn").over(outer), F.lit(0)).alias("g_seen"), "gl")
    groups = groups.withColumn("g_open", F.max(F.col("g_at") + F.col("gl")).over(outer)).drop("gl")
    found = found.where("n > 0").join(groups, ["file", "group"])
    begin = F.col("g_at") + F.col("at")
    before = F.coalesce(F.col("g_at") + F.col("open"), F.col("g_open"), F.lit(-1))
    docs = found.select("file", begin.alias("begin"), before.alias("before"), (F.col("g_seen") + F.col("seen")).alias("first"), "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("before")).otherwise(F.col("begin") + F.get("ends", F.col("i") - 1)) + 1
    return docs.select("file", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("begin") + F.col("end") - start).alias("n_tokens"))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens: documents written as flat files, which are then scanned."""
    spark = docs.sparkSession
    folder = new_folder(spark, "flat")
    names = written(flat_files(docs, folder), "names")
    # a file of a task that was done again is in no row of names
    return scan(read_blocks(spark, folder)).join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))
