"""Sums over ranges of samples at any position and of any length, without a copy of a sample per range.

A range is a difference of positions. Each position becomes one row in its (record, block); samples and positions of a block meet in
one task, in order, and a position takes the sums of all samples of its block before it. A range adds the position of its end, those
of the block ends it passes, and takes off that of its start, so it costs length / block rows, not length. Sums run from the start
of a block, never of the record: rounding errors are those of one block, however long the record is.

Moments about the end of a range are taken about the start of each block and moved there afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(ranges: DataFrame, start: str, end: str, block: int) -> DataFrame:
    """One row per position a range needs: columns of ``ranges``, block, position and sign. Empty ranges have none."""
    first, last = F.floor(F.col(start) / block), F.floor((F.col(end) - 1) / block)
    ends = F.transform(F.sequence(first, last), lambda b: F.struct(
        b.alias("_blk"), F.least(F.col(end).cast("bigint"), (b + 1) * block).alias("_pos"), F.lit(1.0).alias("_sign")))
    begin = F.array(F.struct(first.alias("_blk"), F.col(start).cast("bigint").alias("_pos"), F.lit(-1.0).alias("_sign")))
    return ranges.where(F.col(end) > F.col(start)).select("*", F.inline(F.concat(ends, begin)))


def range_sums(samples: DataFrame, ranges: DataFrame, keys: list[str], sums: dict[str, Column], block: int, start: str = "start",
               end: str = "end", timed: dict[str, str] | None = None, squared: dict[str, str] | None = None,
               scale: float = 1.0) -> DataFrame:
    """``ranges`` with the ``sums`` over their samples start <= n < end and the number of samples ``_cnt``.

    ``timed`` and ``squared`` map a sum to the name of its sum weighted by t or t * t, t = (n - end) / ``scale``. NULL terms add
    nothing; values must be finite (readers give NULL for undefined). A range that holds no sample has no row. Rows of ``ranges``
    must differ; ``n`` and positions are whole and not negative.
    """
    timed, squared = timed or {}, squared or {}
    tau = (F.col("n") - F.col("_blk") * block) / scale
    terms = {"_cnt": F.lit(1.0), **sums}
    need1, need2 = {*timed, *squared}, set(squared)
    by = ranges.columns
    own = samples.withColumn("_blk", F.floor(F.col("n") / block)).select(
        *keys, "_blk", F.col("n").cast("bigint").alias("_pos"),
        *[v.cast("double").alias(f"{k}_0") for k, v in terms.items()],
        *[(terms[k] * tau).alias(f"{k}_1") for k in need1], *[(terms[k] * tau * tau).alias(f"{k}_2") for k in need2])
    marks = positions(ranges, start, end, block).select(
        *keys, "_blk", "_pos", "_sign", F.struct(*[F.col(c) for c in by]).alias("_range"))
    both = marks.unionByName(own, allowMissingColumns=True)
    values = [c for c in own.columns if c not in (*keys, "_blk", "_pos")]
    # A position lies before the sample of its number, so rows with a range come first.
    w = Window.partitionBy(*keys, "_blk").orderBy("_pos", F.col("_range").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({v: F.coalesce(F.sum(v).over(w), F.lit(0.0)) for v in values}).where(F.col("_range").isNotNull())
    shift = (F.col("_blk") * block - F.col(f"_range.{end}")) / scale
    c = F.col
    moved = {k: c(f"{k}_0") for k in terms}
    moved |= {name: c(f"{k}_1") + shift * c(f"{k}_0") for k, name in timed.items()}
    moved |= {name: c(f"{k}_2") + shift * 2.0 * c(f"{k}_1") + shift * shift * c(f"{k}_0") for k, name in squared.items()}
    out = seen.groupBy("_range").agg(*[F.sum(c("_sign") * v).alias(k) for k, v in moved.items()])
    return out.where(F.round("_cnt", 0) > 0).select("_range.*", F.round("_cnt", 0).cast("bigint").alias("_cnt"),
                                                    *[k for k in moved if k != "_cnt"])
