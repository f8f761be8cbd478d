"""Helpers shared by the text operators: tables, folds, label samples, Arrow columns, shared folders."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspark.sources.stage import ensure_checkpoint_dir

#: Rows of one Arrow batch. Texts may be long, so a batch is kept small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark only, so any store that Spark can open will do."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def label_sample(labels: DataFrame, label: str, folds: int, fold: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids outside the held-out fold, taken in hash order: (doc_id, y).

    An id with several labels counts once, with the smallest; ids or labels that are null are left out.
    """
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
           .groupBy("doc_id").agg(F.min(label).cast("int").alias("y")))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Whole texts of sampled rows: (text, y). The sample is broadcast: its row count is bounded by its limit."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def byte_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [v or b"" for v in batch.column(name).to_pylist()]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
