"""Tables stored in buckets of their join key, so that joins, checks and pairings on it need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Rows of a bucket, which one task sorts.
BUCKET_ROWS = 250_000


def bucket_count(rows: int, least: int = 8) -> int:
    """Buckets of a table of about ``rows`` rows: their number grows with the table, not their size."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int, name: str | None = None) -> DataFrame:
    """Write once, in ``buckets`` sorted files, and read through the catalog, which knows the layout.

    The one shuffle is here. Every later join, window or aggregate on all of ``keys`` of tables with as many buckets starts from the
    files. Choose ``buckets`` so that one of them fits a task. A hot key makes a large bucket: buckets are for keys that have few
    rows, such as (episode, window) or (record, block). The table lies in the folder ``path``; the session's catalog holds its name.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, *keys)
    spread.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
