"""Freezing of files: a digest per file, kept as a manifest table, and what has changed since.

Files are listed by Spark's binary file source without their contents. Only files that the manifest does not hold with the same
length and time of change are read and digested, each in the task that reads it, so a repeated freeze costs a listing. A file of
up to ``WHOLE_BYTES`` is one row while it is digested, read by Spark. A larger one is read by its task in pieces, by Arrow's file
systems, so its path is one that every executor can open; its size has no limit, but a SHA-256 is sequential, so it stays one task.
The source passes over empty files, so they are in no manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspark.sources.record_source import open_path

#: Size up to which a file is held as one row, and bytes read at once of a larger one.
WHOLE_BYTES, PIECE_BYTES = 256 << 20, 8 << 20
COLUMNS = ["path", "length", "modified", "sha256"]


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
            .withColumnRenamed("modificationTime", "modified"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of files that are read in pieces."""
    for b in batches:
        digests = []
        for path in b.column("path").to_pylist():
            system, name = open_path(path)
            with system.open_input_stream(name) as f:
                sha = hashlib.sha256()
                while piece := f.read(PIECE_BYTES):
                    sha.update(piece)
            digests.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], names=[*b.schema.names, "sha256"])


def _digested(files: DataFrame) -> DataFrame:
    """``files`` with their digests. The source lists large files one to a partition and reads contents of small ones only."""
    large = files.where(F.col("length") > WHOLE_BYTES).select(*COLUMNS[:3])
    small = files.where(F.col("length") <= WHOLE_BYTES).select(*COLUMNS[:3], F.sha2("content", 256).alias("sha256"))
    if large.isEmpty():
        return small
    return small.unionByName(large.mapInArrow(_pieces, large.select("*", F.lit("").alias("sha256")).schema))


def freeze(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """The manifest (path, length, modified, sha256) of all files under ``path``, taking digests of unchanged files from ``known``."""
    listed = _files(spark, path).select(*COLUMNS[:3])
    if known is None:
        return _digested(_files(spark, path))
    same = listed.join(known.select(*COLUMNS), COLUMNS[:3])
    fresh = [r.path for r in listed.join(known, COLUMNS[:3], "left_anti").select("path").toLocalIterator()]  # names only
    if not fresh:
        return same.select(*COLUMNS)
    return same.select(*COLUMNS).unionByName(_digested(_files(spark, fresh)))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): files that are new, missing or of another content; a file that was only touched is none of these."""
    a, b = (df.select("path", F.col("sha256").alias(f"sha_{k}")) for k, df in (("old", old), ("new", new)))
    change = (F.when(F.col("sha_old").isNull(), "added").when(F.col("sha_new").isNull(), "missing")
              .when(F.col("sha_old") != F.col("sha_new"), "changed"))
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")
