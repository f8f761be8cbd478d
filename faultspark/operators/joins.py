"""Joins with checked cardinality. Checks run inside the plan, not as actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultspark.operators.numbering import best_row


def must(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Fail the job on the first row that breaks the condition."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def checked_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """Fail if a key repeats; needs only the shuffle the join needs anyway."""
    w = Window.partitionBy(*keys).orderBy(*keys)
    return must(df.withColumn("_nth", F.row_number().over(w)), F.col("_nth") == 1,
                f"{what}: key ({', '.join(keys)}) is not unique").drop("_nth")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def with_sample_key(df: DataFrame, post: str = "post_ms", fs: float = 9600.0, out: str = "k") -> DataFrame:
    """Integer window key: samples after inception, safe against rounding."""
    return df.withColumn(out, F.round(F.col(post) * (fs / 1000.0), 0).cast("int"))


def join_one_to_one(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return checked_unique(a, keys, "left").join(checked_unique(b, keys, "right"), keys, how)


def join_complete(a: DataFrame, b: DataFrame, keys: list[str], need: list[str]) -> DataFrame:
    """Left one-to-one join in which every ``need`` column must be found."""
    out = join_one_to_one(a, b, keys, "left")
    ok = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in need])
    return must(out, ok, f"no match for {', '.join(need)}")


def join_outer_indicator(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with the origin of each row in ``_merge``."""
    out = a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), keys, "full_outer")
    origin = (F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both")
              .when(F.col("_l").isNotNull(), "left_only").otherwise("right_only"))
    return out.withColumn("_merge", origin).drop("_l", "_r")


def only_in(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys), keys, "left_semi")


def not_in(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys), keys, "left_anti")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in both sets; must be empty for disjoint train and test sets."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi")


def misaligned(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str], tol: float) -> DataFrame:
    """Rows missing on one side or differing by more than ``tol``."""
    right = b.select(*keys, *[F.col(c).alias(f"o_{c}") for c in cols])
    j = join_outer_indicator(a.select(*keys, *cols), right, keys)
    far = F.col("_merge") != "both"
    for c in cols:
        x, y = F.col(c), F.col(f"o_{c}")
        far = far | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol, F.lit(False))
    return j.where(far)


def assemble(base: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Chain of one-to-one joins on one key; shuffles of the base are reused."""
    out = checked_unique(base, keys, "base")
    for p in parts:
        out = out.join(checked_unique(p, keys, "part"), keys)
    return out


def map_attribute(df: DataFrame, dim: DataFrame, key: list[str], attrs: list[str]) -> DataFrame:
    """Per-line attribute from a de-duplicated table; every key must be known."""
    d = checked_unique(dim.select(*key, *attrs).distinct(), key, "attributes")
    out = df.join(d, key, "left")
    return must(out, reduce(lambda x, y: x & y, [F.col(a).isNotNull() for a in attrs]), "unknown key")


def best_then_rows(preds: DataFrame, group: list[str], model: str, err: str, salts: int = 256) -> DataFrame:
    """Rows of the model with the smallest mean error in each group.

    Groups and models are few and may hold most rows each, so the join key has
    a salt: a group's rows are spread over up to ``salts`` tasks, and its one
    winner goes to each of them.
    """
    means = preds.groupBy(*group, model).agg(F.avg(err).alias("_mae"))
    best = best_row(means, group, F.col("_mae"), F.col(model)).select(*group, model)
    best = best.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_salt"))
    rows = preds.withColumn("_salt", F.pmod(F.xxhash64(*preds.columns), F.lit(salts)))
    return rows.join(best, [*group, model, "_salt"]).drop("_salt")
