"""Cutting lineage before iterative work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """Use the shared folder of the session; only a local test sets its own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder name in the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def no_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of queries made and run inside when they end."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` stored in the checkpoint folder and read from there: survives the loss of executors.

    The rows are made once (a checkpoint counts them first and makes them again) and stored by columns, compressed. The shuffle
    files of that pass are removed when it is done, so those of a chain of stored steps do not add up.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, "stored")
    with no_shuffle_files(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored step that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def parts(rows: int, key: str, most: int) -> list[Column]:
    """Conditions that deal a table of ``rows`` rows by ``key`` into parts of about ``most``, so that the files that a step leaves
    while it runs are those of one part. Every row is in one part."""
    count = max(1, -(-rows // most))
    return [F.pmod(F.xxhash64(F.col(key), F.lit(29)), F.lit(count)) == k for k in range(count)]
