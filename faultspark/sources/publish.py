"""Tables that change in two steps: parts are written first, then one manifest names them.

A table is a folder with ``parts/<batch>-<id>`` and numbered manifests, small files that list batch and part. Readers see the
newest manifest, so a part is seen whole or not at all. A manifest gets its number by a rename that fails where the name is taken,
so of two writers one must read again and try the next number. A batch that a manifest names is not added again: a run may be
killed anywhere and repeated. A replaced batch stays in the manifest without a part, so a late repetition of it adds nothing. Parts that no manifest names are left behind by killed runs and may be deleted when no writer is at work.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Writers that meet at one number before one of them gives up.
ATTEMPTS = 50


class Conflict(RuntimeError):
    """Too many writers at one table."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs = _filesystem(spark, folder)
    at = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _latest(spark: SparkSession, path: str) -> int:
    return max((int(n.split(".")[0]) for n in _names(spark, f"{path}/manifests") if n.endswith(".json")), default=0)


def manifest_of(spark: SparkSession, path: str) -> tuple[int, dict[str, str | None]]:
    """Number of the newest manifest (0: none) and its parts by batch, None for replaced ones."""
    number = _latest(spark, path)
    if number == 0:
        return 0, {}
    return number, json.loads(spark.sparkContext.wholeTextFiles(f"{path}/manifests/{number:012d}.json").values().first())


def _claim(spark: SparkSession, path: str, number: int, parts: dict[str, str | None]) -> bool:
    """Write manifest ``number``; False if it is there already."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    draft, final = f"{path}/manifests/{uuid.uuid4().hex}.draft", f"{path}/manifests/{number:012d}.json"
    out = _filesystem(spark, draft).create(_path(spark, draft), False)
    out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, draft).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, draft), _path(spark, final), gateway.new_array(rename, 0))
    except Exception as e:  # noqa: BLE001
        if "FileAlreadyExistsException" not in str(e):
            raise
        return False
    return True


def write_part(df: DataFrame, path: str, batch: str) -> str:
    """First step: the rows of a batch in a folder of their own; no reader sees them yet."""
    part = f"{batch}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/parts/{part}")
    return part


def name_part(spark: SparkSession, path: str, batch: str, part: str, replace: bool = False) -> bool:
    """Second step: a manifest with the part, alone if it is to ``replace`` the table. False if the batch is there already."""
    for _ in range(ATTEMPTS):
        number, parts = manifest_of(spark, path)
        if batch in parts:
            return False
        if _claim(spark, path, number + 1, (dict.fromkeys(parts) if replace else parts) | {batch: part}):
            return True
    raise Conflict(f"{path}: no free number in {ATTEMPTS} attempts")


def publish(df: DataFrame, path: str, batch: str, replace: bool = False) -> bool:
    """Add a batch once, or ``replace`` all others by it. A batch that is there already costs no job."""
    if "/" in batch:
        raise ValueError("the name of a batch holds no slash")
    spark = df.sparkSession
    if batch in manifest_of(spark, path)[1]:
        return False
    return name_part(spark, path, batch, write_part(df, path, batch), replace)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all parts that the newest manifest names. A reader keeps its parts while writers go on."""
    parts = [p for p in manifest_of(spark, path)[1].values() if p is not None]
    if not parts:
        raise AnalysisException(f"{path}: nothing is published")
    return spark.read.parquet(*[f"{path}/parts/{p}" for p in parts])


def unnamed_parts(spark: SparkSession, path: str) -> list[str]:
    """Folders that the newest manifest does not name: killed runs, replaced parts, and those still being written."""
    return sorted(set(_names(spark, f"{path}/parts")) - set(manifest_of(spark, path)[1].values()))
