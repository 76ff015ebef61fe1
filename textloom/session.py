"""Workers import this package: where they can't find it, it is sent to them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
#: Rows and bytes of one Arrow batch sent to Python, so that a worker's memory doesn't grow with the partition.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession | None = None) -> None:
    """Bounds Arrow batches (unless the session does) and lets workers import this package."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))
    ship(spark)


def ship(spark: SparkSession | None = None) -> None:
    """Sends the package to workers, once for each context, unless their path or working folder holds it already."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if str(ROOT) in path or os.path.realpath(os.getcwd()) == str(ROOT) or getattr(sc, "_textloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "textloom_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (ROOT / "textloom").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(archive))
    sc._textloom_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores is dealt out to all of them; a larger one stays as it is and isn't shuffled.

    What is dealt out is below a block of a file for each core, so that this costs little wherever it happens.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
