"""Writers: partitioned tables, resumable appends, versioned patches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, one directory per partition value.

    Rows are spread over as many tasks as the shuffle setting asks for; a
    partition value is not forced into one task.
    """
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_windows(df: DataFrame, path: str, channels: list[str], by: list[str] | None = None) -> None:
    """Window tensors as FLOAT arrays next to their keys."""
    write_table(df.withColumns({c: F.col(c).cast("array<float>") for c in channels}), path, by)


def missing_rows(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target does not hold yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def append_missing(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    """Resumable run: add only the keys that are not in the table.

    The key is part of the data, so a re-run after a lost job adds nothing
    twice.
    """
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    (df if done is None else missing_rows(df, done, keys)).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Small result table as one CSV part."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def union_parts(parts: dict[str, DataFrame], label: str, keys: DataFrame | None = None,
                on: list[str] | None = None) -> DataFrame:
    """Partial results under one label column, joined to their key table."""
    tagged = [df.withColumn(label, F.lit(name)) for name, df in parts.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return out if keys is None else out.join(keys, on)


def patch_table(spark: SparkSession, old_path: str, new_path: str, fn: Callable[[DataFrame], DataFrame],
                allowed: list[str]) -> None:
    """Write a fixed version next to an untouched original.

    Only ``allowed`` columns may be replaced. The fix is always computed from
    the original, so a second run gives the same table.
    """
    old = spark.read.parquet(old_path)
    new = fn(old)
    if new.columns != old.columns:
        raise ValueError("a patch must keep the columns")
    fixed = old.columns
    marker = {f"_old_{c}": F.col(c) for c in fixed if c not in allowed}
    both = fn(old.withColumns(marker))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(o)) for o, c in
                                       ((f"_old_{c}", c) for c in fixed if c not in allowed)], F.lit(True))
    guard = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("patch changed a fixed column")).cast("boolean"))
    both.where(guard).select(*fixed).write.mode("overwrite").parquet(new_path)
