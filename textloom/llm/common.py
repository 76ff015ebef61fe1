"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textloom.session import prepare, spread

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and the columns named, whatever else there is."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset and all runs in one process (tests), a folder of this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = getattr(sc, "_textloom_dir", None) or tempfile.mkdtemp(prefix="textloom-")
        sc._textloom_dir = found
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder; what stands there is deleted when the driver's process ends, however it does."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and a lost executor costs nothing made before."""
    path = f"{new_folder(df.sparkSession, name)}/table"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def counted(df: DataFrame, name: str, *what: Column) -> tuple[DataFrame, list[int]]:
    """written(), and sums of columns of its rows (at first their number), observed while they are written."""
    seen = Observation()
    sums = [F.count(F.lit(1)).alias("n0"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"n{i}") for i, c in enumerate(what, 1)]]
    out = written(df.observe(seen, *sums), name)
    got = seen.get
    return out, [got[f"n{i}"] for i in range(len(what) + 1)]


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it again."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent().getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def rows(batch: pa.RecordBatch, **kinds: pa.DataType) -> Iterator[tuple]:
    """The named columns of a batch, cast, row by row."""
    return zip(*(batch.column(k).cast(t).to_pylist() for k, t in kinds.items()), strict=True)


def batch(schema: pa.Schema, got: list[tuple]) -> pa.RecordBatch:
    cols = zip(*got, strict=True) if got else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def emitted(schema: pa.Schema, found: Iterator[tuple], most: int = 2000, weigh: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded length."""
    got: list[tuple] = []
    size = 0
    for row in found:
        got.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(got) >= most or size >= weigh:
            yield batch(schema, got)
            got, size = [], 0
    if got:
        yield batch(schema, got)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The fold never learnt from: crc32 of the id as text, modulo 5, is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))
