"""Ranks, running totals and exact quantiles without one-task groups.

A plain ``row_number`` or ``percentile`` brings a whole group to one task. Here
every group is cut into value buckets; the bucket totals (a small table) are
accumulated in two levels, and only rows of one bucket are ever ordered
together. Results are exact, and a group may hold most of the table. NULL is a
group key like any other value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per super-bucket in the two-level accumulation.
FAN = 4096
#: Value buckets per factor of two in :func:`magnitude_bucket`.
PER_OCTAVE = 4096


def magnitude_bucket(x: Column, per_octave: int = PER_OCTAVE) -> Column:
    """Order-preserving integer bucket of a DOUBLE on a logarithmic scale."""
    size = F.floor((F.log2(F.abs(x) + F.lit(1e-300)) + F.lit(1000.0)) * per_octave)
    return F.when(x < 0, -size).otherwise(size).cast("bigint")


def group_key(keys: list[str]) -> dict[str, Column]:
    """One key column for joins and windows; structs are equal when their NULL fields are."""
    return {"__key": F.struct(*keys)} if keys else {}


def plain_keys(df: DataFrame, keys: list[str]) -> dict[str, Column]:
    """Key columns without NULLs, equal where NULL equals NULL. Numbers and texts stay such, which sort faster than structs."""
    types, out, null = dict(df.dtypes), {}, F.lit(0)
    for i, k in enumerate(keys):
        if types[k] in ("tinyint", "smallint", "int", "bigint", "string"):
            out[f"__k{i}"] = F.coalesce(F.col(k), F.lit("" if types[k] == "string" else 0).cast(types[k]))
            null = null + F.when(F.col(k).isNull(), 1 << i).otherwise(0)
        else:
            out[f"__k{i}"] = F.struct(k)
    return {**out, "__null": null} if keys else {}


#: Bucket of rows whose order value is NULL.
NO_BUCKET = -(1 << 62)


def join_groups(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; ``keys`` must not be empty."""
    return (df.withColumns(group_key(keys)).join(other.withColumns(group_key(keys)).drop(*keys), "__key", how).drop("__key"))


def prefix_sum(df: DataFrame, keys: list[str], order: list, weight: Column,
               bucket: Column, out: str = "before", fan: int = FAN, total: str | None = None) -> DataFrame:
    """Add the sum of ``weight`` over the earlier rows of the same group, and its ``total`` if named.

    ``bucket`` must not decrease along ``order``; the order must be total for
    the result to be unique. ``keys`` may be empty. Rows are dealt by (group,
    bucket) and sorted once, for the ordering and for the join with the bucket's offset.
    Rows without a bucket come before all others.
    """
    key = list(plain_keys(df, keys))
    rows = df.withColumns({**plain_keys(df, keys), "__bkt": F.coalesce(bucket.cast("bigint"), F.lit(NO_BUCKET)), "__wgt": weight})
    totals = (rows.groupBy(*key, "__bkt").agg(F.sum("__wgt").alias("__bw"))
              .withColumn("__sup", F.floor(F.col("__bkt") / fan)))
    zero = F.lit(0)
    earlier = (Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    supers = totals.groupBy(*key, "__sup").agg(F.sum("__bw").alias("__sw")).select(
        *key, "__sup", F.coalesce(F.sum("__sw").over(whole.orderBy("__sup").rowsBetween(*earlier)), zero).alias("__so"),
        F.sum("__sw").over(whole).alias("__all"))
    wb = Window.partitionBy(*key, "__sup").orderBy("__bkt").rowsBetween(*earlier)
    offsets = totals.join(supers, [*key, "__sup"]).select(
        *key, "__bkt", (F.col("__so") + F.coalesce(F.sum("__bw").over(wb), zero)).alias("__off"), "__all")
    wr = Window.partitionBy(*key, "__bkt").orderBy(*order).rowsBetween(*earlier)
    # Ordered first and joined then: the join finds the rows dealt and sorted as it needs them.
    inside = rows.withColumn("__in", F.coalesce(F.sum("__wgt").over(wr), zero))
    done = inside.join(offsets, [*key, "__bkt"]).withColumn(out, F.col("__off") + F.col("__in"))
    if total:
        done = done.withColumn(total, F.col("__all"))
    return done.drop(*key, "__bkt", "__wgt", "__in", "__off", "__all")


def number_rows(df: DataFrame, keys: list[str], order: list, bucket: Column,
                out: str = "n", total: str | None = None) -> DataFrame:
    """Zero-based position of every row in its group, and the group's size if ``total`` is named."""
    return prefix_sum(df, keys, order, F.lit(1).cast("bigint"), bucket, out, total=total)


def value_counts(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Multiplicity of each distinct defined value (combined map-side)."""
    return (df.where(F.col(x).isNotNull())
            .groupBy(*keys, F.col(x).cast("double").alias("x"))
            .agg(F.count(F.lit(1)).alias("w")))


def quantiles(df: DataFrame, keys: list[str], x: str, probs: dict[str, float],
              per_octave: int = PER_OCTAVE) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    One pass counts values per bucket; only the buckets that hold a wanted
    rank are then ordered.
    """
    key = list(group_key(keys))
    v = value_counts(df, keys, x).withColumns({"_b": magnitude_bucket(F.col("x"), per_octave), **group_key(keys)})
    per_bucket = v.groupBy(*key, "_b").agg(F.sum("w").alias("_bw"))
    w_key = Window.partitionBy(*key)
    ranked = per_bucket.withColumns({
        "_n": F.sum("_bw").over(w_key),
        "_o": F.coalesce(
            F.sum("_bw").over(w_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)),
    })
    wanted = []
    for name, q in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        for side, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            wanted.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"),
                                   r.alias("r"), (pos - F.floor(pos)).alias("t")))
    hit = lambda lo, size: (lambda s: (s["r"] >= lo) & (s["r"] < lo + size))
    targets = (ranked
               .withColumn("_want", F.filter(F.array(*wanted), hit(F.col("_o"), F.col("_bw"))))
               .where(F.size("_want") > 0)
               .select(*key, "_b", "_o", "_want"))
    w_in = Window.partitionBy(*key, "_b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    found = (v.join(targets, [*key, "_b"])
             .withColumn("_at", F.col("_o") + F.coalesce(F.sum("w").over(w_in), F.lit(0)))
             .select(*keys, "x", F.explode(F.filter("_want", hit(F.col("_at"), F.col("w")))).alias("_t")))
    pick = lambda n, s: F.max(F.when((F.col("_t.name") == n) & (F.col("_t.side") == s), F.col("x")))
    aggs = []
    for name in probs:
        t = F.max(F.when(F.col("_t.name") == name, F.col("_t.t")))
        aggs.append((pick(name, "lo") + (pick(name, "hi") - pick(name, "lo")) * t).alias(name))
    return found.groupBy(*keys).agg(*aggs).select(*keys, *probs)


def column_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Quantiles of several columns in one pass: {column: {output: prob}}."""
    cells = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in wanted]
    long = df.select(*keys, F.inline(F.array(*cells)))
    probs = {f"_q{p}": p for p in sorted({p for w in wanted.values() for p in w.values()})}
    q = quantiles(long, [*keys, "_c"], "_v", {n.replace(".", "_"): p for n, p in probs.items()})
    aggs = [F.max(F.when(F.col("_c") == c, F.col(f"_q{p}".replace(".", "_")))).alias(name)
            for c, w in wanted.items() for name, p in w.items()]
    names = [name for w in wanted.values() for name in w]
    return q.groupBy(*keys).agg(*aggs).select(*keys, *names)


def ecdf(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Empirical distribution: one row per distinct value and group."""
    run = prefix_sum(value_counts(df, keys, x), keys, ["x"], F.col("w"), magnitude_bucket(F.col("x")), total="n")
    return run.select(*keys, F.col("x").alias(x), F.col("w").alias("n_at"),
                      ((F.col("before") + F.col("w")) / F.col("n")).alias("ecdf"))


def group_codes(df: DataFrame, col: str, bucket: Column, out: str = "code") -> DataFrame:
    """Dense zero-based code of each distinct value, in value order."""
    return number_rows(df.select(col).where(F.col(col).isNotNull()).distinct(), [], [col], bucket, out)


def first_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First k rows per group; Spark limits each group before its shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def best_row(df: DataFrame, keys: list[str], by: Column, tie: Column | None = None) -> DataFrame:
    """Row with the smallest ``by`` per group, as a combinable aggregate."""
    cols = [c for c in df.columns if c not in keys]
    rank = F.struct(by.alias("by"), (tie if tie is not None else F.lit(0)).alias("tie"))
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*cols), rank).alias("_best"))
            .select(*keys, "_best.*"))


def stratified_pick(df: DataFrame, strata: list[str], unit: str, k: int, seed: int = 0) -> DataFrame:
    """k distinct units per stratum (all, if fewer), chosen by keyed hash."""
    from faultspark.functions.draws import hash64

    units = df.select(*strata, unit).distinct()
    return first_k(units.withColumn("_h", hash64(seed, F.col(unit))), strata, ["_h", unit], k).drop("_h")
