"""Episode bootstrap, grouped splits and simple fitted baselines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.functions.draws import hash64, md5_60
from faultspark.operators.numbering import join_groups, number_rows, plain_keys, quantiles

#: Episodes per multinomial bucket.
BUCKET = 2048


def episode_sums(df: DataFrame, by: list[str], episode: str, errors: dict[str, Column]) -> DataFrame:
    """Error sums and window counts per episode; all a resample needs."""
    return df.groupBy(*by, episode).agg(*[F.sum(e).alias(k) for k, e in errors.items()],
                                        F.count(F.lit(1)).cast("double").alias("wins"))


def indexed(sums: DataFrame, by: list[str], episode: str, width: int = 4096) -> DataFrame:
    """Zero-based episode index and episode count per group."""
    return number_rows(sums, by, [episode], F.floor(F.col(episode) / width), "idx", total="n_ep")


def hash_replicates(df: DataFrame, by: list[str], episode: str, errors: dict[str, Column], b: int,
                    seed: int = 0) -> DataFrame:
    """Resampled sums per replicate from keyed hash draws.

    Slot j of replicate r draws an episode index from md5(seed, r, j). Draws
    meet the episode sums in an equi-join on the index, so any size works and
    any SQL engine can repeat it.
    """
    ep = indexed(episode_sums(df, by, episode, errors), by, episode)
    key = list(plain_keys(ep, by))
    sums = ep.select(*[v.alias(k) for k, v in plain_keys(ep, by).items()], *by, "idx", "n_ep", *errors, "wins")
    slots = sums.select(*key, "n_ep", "idx")
    schema = ", ".join([*[f"`{k}` {t}" for k, t in slots.dtypes if k in key], "rep int", "idx bigint"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, n = batch.column("idx").to_numpy(), batch.column("n_ep").to_numpy()
            for rep in range(b):
                cells = [pa.array(np.full(len(slot), rep, np.int32)), pa.array(md5_60(f"{seed}|{rep}|", slot) % n)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], *cells], names=[*key, "rep", "idx"])

    # Few bytes make many draws, so they are spread by number of rows and not by size.
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = slots.repartition(spread, *key, "idx").mapInArrow(draw, schema)
    # An episode meets about b draws: a hash table of its side spares the sort of all draws.
    hit = draws.join(sums.drop("n_ep").hint("shuffle_hash"), [*key, "idx"])
    return hit.groupBy(*by, "rep").agg(*[F.sum(k).alias(k) for k in errors], F.sum("wins").alias("wins"))


def _bucket_counts(n: int, bucket: int, b: int, seed: int, size: int):
    """Draws of every replicate that fall in one bucket of ``size`` episodes.

    The bucket's share of the n draws is found by halving the bucket range:
    each split is a binomial seeded by its range, so all tasks agree on it
    without exchanging anything, and the counts are exactly multinomial.
    """
    lo, hi = 0, -(-n // size)
    left_of = lambda k: min(k * size, n)
    m = np.full(b, n, dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        p = (left_of(mid) - left_of(lo)) / (left_of(hi) - left_of(lo))
        first = np.random.default_rng([seed, lo, hi]).binomial(m, p)
        if bucket < mid:
            m, hi = first, mid
        else:
            m, lo = m - first, mid
    return m


def multinomial_replicates(df: DataFrame, by: list[str], episode: str, errors: dict[str, Column], b: int,
                           seed: int = 0, size: int = BUCKET) -> DataFrame:
    """Resampled sums per replicate without moving draws between tasks.

    Work is b * episodes counts inside bounded buckets; the shuffle carries b
    rows per bucket instead of b per episode.
    """
    ep = indexed(episode_sums(df, by, episode, errors), by, episode)
    names = [*errors, "wins"]
    ep = ep.withColumn("_bucket", F.floor(F.col("idx") / size))
    fields = {f.name: f.dataType.simpleString() for f in ep.schema.fields}
    schema = ", ".join([*[f"`{k}` {fields[k]}" for k in by], "rep int", *[f"`{n}` double" for n in names]])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        bucket, n = int(pdf["_bucket"].iloc[0]), int(pdf["n_ep"].iloc[0])
        m = _bucket_counts(n, bucket, b, seed, size)
        rng = np.random.default_rng([seed, bucket, n, 1])
        values = [np.ascontiguousarray(pdf[k].to_numpy(float)) for k in names]
        sums = np.zeros((b, len(names)))
        for lo in range(0, b, 256):  # replicates in slices keep the draws small
            part = m[lo:lo + 256]
            picks = rng.integers(0, len(pdf), int(part.sum()))
            drawn = np.flatnonzero(part)  # draws of a replicate lie together, so they are summed in runs
            starts = (np.cumsum(part) - part)[drawn]
            for k, v in enumerate(values):
                if len(drawn):
                    sums[lo + drawn, k] = np.add.reduceat(v[picks], starts)
        out = pd.DataFrame(sums, columns=names)
        out.insert(0, "rep", np.arange(b, dtype="int32"))
        for k in reversed(by):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    parts = ep.groupBy(*by, "_bucket").applyInPandas(draw, schema)
    return parts.groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])


def percentile_ci(reps: DataFrame, by: list[str], stat: Column, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval over the replicates (a fixed, small number)."""
    return reps.withColumn("_s", stat).groupBy(*by).agg(
        F.percentile("_s", lo).alias("ci_lo"), F.percentile("_s", hi).alias("ci_hi"))


def bootstrap_ci(df: DataFrame, by: list[str], episode: str, err: Column, b: int = 2000, seed: int = 0,
                 draws: str = "multinomial") -> DataFrame:
    """Mean error with an episode-bootstrap interval."""
    errors = {"_e": err}
    make = multinomial_replicates if draws == "multinomial" else hash_replicates
    reps = make(df, by, episode, errors, b, seed)
    point = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"))
    ci = percentile_ci(reps, by, F.col("_e") / F.col("wins"))
    return _join_by(point, ci, by)


def paired_reduction(df: DataFrame, by: list[str], episode: str, ours: Column, base: Column, b: int = 2000,
                     seed: int = 0, draws: str = "multinomial") -> DataFrame:
    """Relative reduction 1 - ours/base with both methods on the same resamples."""
    errors = {"_a": ours, "_b": base}
    make = multinomial_replicates if draws == "multinomial" else hash_replicates
    reps = make(df, by, episode, errors, b, seed)
    point = df.groupBy(*by).agg(((1 - F.sum(ours) / F.sum(base)) * 100).alias("reduction"))
    return _join_by(point, percentile_ci(reps, by, (1 - F.col("_a") / F.col("_b")) * 100), by)


def _join_by(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return join_groups(a, b, by)
    row = a.withColumn("_row", b.select(F.struct(*b.columns)).scalar())
    return row.withColumns({c: F.col(f"_row.{c}") for c in b.columns}).drop("_row")


# --- grouped splits --------------------------------------------------------------

def episode_ranks(df: DataFrame, episode: list[str], seed: int) -> DataFrame:
    """Distinct episodes with a random but reproducible rank and their count."""
    ids = df.select(*episode).distinct().withColumn("_h", hash64(seed, *[F.col(e) for e in episode]))
    return number_rows(ids, [], ["_h", *episode], F.shiftright("_h", 44), "_rank", total="_n").drop("_h")


def grouped_split(df: DataFrame, episode: list[str], share: float = 0.3, seed: int = 0) -> DataFrame:
    """Mark exactly round(share * n) episodes, with all their windows, as test."""
    r = episode_ranks(df, episode, seed)
    take = F.bround(F.col("_n") * share, 0)
    split = F.when(F.col("_rank") < take, "test").otherwise("train")
    return df.join(r.select(*episode, split.alias("split")), episode)


def grouped_validation(df: DataFrame, episode: list[str], seed: int = 0) -> DataFrame:
    """Mark max(1, n // 10) episodes as validation."""
    r = episode_ranks(df, episode, seed)
    take = F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    return df.join(r.select(*episode, (F.col("_rank") < take).alias("is_val")), episode)


# --- fitted baselines --------------------------------------------------------------

def calibrated_ratio(train: DataFrame, test: DataFrame, est: str, y: str, out: str = "cal") -> DataFrame:
    """a + b * est with a, b from ordinary least squares on the training rows."""
    tr = train.where(F.col(est).isNotNull() & F.col(y).isNotNull())
    a = tr.agg(F.regr_intercept(y, est).alias("a")).scalar()
    b = tr.agg(F.regr_slope(y, est).alias("b")).scalar()
    return test.withColumns({"coef_a": a, "coef_b": b}).withColumn(out, F.col("coef_a") + F.col("coef_b") * F.col(est))


def constant_baseline(train: DataFrame, test: DataFrame, y: str, out: str = "const") -> DataFrame:
    """Training median as the prediction of every test row."""
    return test.withColumn(out, quantiles(train, [], y, {"m": 0.5}).scalar())


def standardise_on_train(df: DataFrame, cols: list[str], is_train: Column, eps: float = 1e-6) -> DataFrame:
    """(x - mean) / (sd + eps) with population moments of the training rows."""
    fit = df.where(is_train).agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).alias("fit"))
    out = df.withColumn("_fit", fit.scalar())
    return out.withColumns({c: (F.col(c) - F.col(f"_fit.m_{c}")) / (F.col(f"_fit.s_{c}") + eps) for c in cols}).drop("_fit")
