"""A search over documents as they arrive: matching is stateless; ranking, which needs the whole corpus, is done again for each batch over what has matched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.engine import Engine, Options


def read(spark: SparkSession, path: str, schema, files_at_once: int = 100, source: str = "parquet") -> DataFrame:
    """A stream of the files that a folder holds and gets."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(source).load(path)


def matches(docs: DataFrame, query: str, options: Options = Options(), engine: Engine | None = None) -> DataFrame:
    """The matching documents of a stream, as they arrive."""
    return (engine or Engine()).match(docs, query, options).hits


def write(df: DataFrame, path: str, checkpoint: str, every: str | None = None, source: str = "parquet") -> StreamingQuery:
    """Appends a stream to a folder: what there is, and then ends; or at an interval, without an end."""
    out = df.writeStream.format(source).outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start(path)


def ranked(docs: DataFrame, query: str, path: str, checkpoint: str, show: Callable[[DataFrame, int], None], options: Options = Options(), engine: Engine | None = None) -> StreamingQuery:
    """Keeps what matches in a folder, a part for each batch, and shows all of it, ranked, after each.

    Beside the parts stands how many documents each batch held, since scores depend on how many were searched. A batch that is
    done again writes its own part again, so nothing counts twice.
    """
    engine = engine or Engine()

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        engine.match(batch, query, options).hits.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/_scanned/batch={number}")
        scanned = spark.read.schema("n long").parquet(f"{path}/_scanned").agg(F.sum("n")).first()[0]
        kept = spark.read.schema(batch.schema).parquet(path).drop("batch")
        found = engine.match(kept, query, options)
        show(engine.rank(kept, found, options, scanned=scanned), number)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
