"""Circular delay of sampled records by a transform in two steps, so that a record of any length is spread over tasks.

A record of N = P Q samples is read as P rows of Q. First the samples n2, n2 + Q, n2 + 2 Q, ... of each column are transformed (P values)
and turned by exp(-2 pi i n2 k1 / N); then, for each k1, the values of all columns (Q of them), which gives the spectrum at k1 + P k2.
There every frequency is turned by its delay, and the same way leads back: across the columns of k1, turned, and down each
column. No group holds more than P or Q values. P is the largest divisor of N up to its root, so a record whose length is a
prime number has one group; pad such records.

The three shuffles are on (record, column), (record, k1) and (record, column).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.operators.numbering import join_groups


def _columns_of(n: Column) -> Column:
    """Q: N over its largest divisor up to the root."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    divisors = F.filter(F.sequence(F.lit(1).cast("long"), root), lambda d: n % d == 0)
    return (n / F.array_max(divisors)).cast("long")


def _list(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def _mapped(rows: DataFrame, keys: list[str], at: str, fn) -> DataFrame:
    """Apply ``fn(values, place, N, Q)`` to the complex values of each row (keys, at, len, q, re, im), which are in order."""
    kinds = dict(rows.dtypes)
    names = [*keys, at, "len", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            re, im = b.column("re").to_pylist(), b.column("im").to_pylist()
            out = [fn(np.array(x) + 1j * np.array(y), k, n, q) for x, y, k, n, q in zip(re, im, *(b.column(c).to_pylist() for c in (at, "len", "q")))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], _list([z.real for z in out]), _list([z.imag for z in out])], names=[*names, "re", "im"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", re array<double>, im array<double>")


def _gathered(rows: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """Values of each (keys, at) as arrays in the order of ``order``."""
    met = rows.groupBy(*keys, at).agg(F.max("len").alias("len"), F.max("q").alias("q"), F.array_sort(F.collect_list(F.struct(order, "re", "im"))).alias("_v"))
    return met.select(*keys, at, "len", "q", F.col("_v.re").alias("re"), F.col("_v.im").alias("im"))


def _spread(rows: DataFrame, keys: list[str], at: str, place: str) -> DataFrame:
    pairs = F.arrays_zip("re", "im")
    return rows.select(*keys, at, "len", "q", F.posexplode(pairs).alias(place, "_v")).select(*keys, at, "len", "q", F.col(place).cast("long").alias(place), "_v.re", "_v.im")


def fractional_delay(samples: DataFrame, keys: list[str], col: str, tau_s: float, fs: float) -> DataFrame:
    """(keys, n, col): every record delayed by ``tau_s`` seconds, as if it went round.

    (keys, n) is unique and n runs from 0; a record that lacks a sample, or has an undefined one, is undefined throughout.
    Samples without n are dropped.
    """
    kind = dict(samples.dtypes)["n"]
    rows = samples.where("n is not null").select(*keys, F.col("n").cast("long").alias("n"), F.coalesce(F.col(col).cast("double"), F.lit(float("nan"))).alias("re"))
    sizes = rows.groupBy(*keys).agg((F.max("n") + 1).alias("len"), F.count(F.lit(1)).alias("_cnt"))
    sizes = sizes.withColumns({"q": _columns_of(F.col("len")), "_whole": F.col("_cnt") == F.col("len")}).drop("_cnt")
    met = join_groups(rows, sizes, keys)
    met = met.withColumns({"n2": F.pmod("n", F.col("q")), "n1": F.floor(F.col("n") / F.col("q")), "im": F.lit(0.0),
                           "re": F.when(F.col("_whole"), F.col("re")).otherwise(float("nan"))})

    def down(x: np.ndarray, n2: int, n: int, q: int) -> np.ndarray:
        return np.fft.fft(x) * np.exp(-2j * np.pi * n2 * np.arange(len(x)) / n)

    def across(x: np.ndarray, k1: int, n: int, q: int) -> np.ndarray:
        k = k1 + n // q * np.arange(len(x))
        signed = np.where(2 * k > n, k - n, k)
        turn = np.exp(-2j * np.pi * signed * fs / n * tau_s)
        turn[2 * k == n] = np.cos(np.pi * fs * tau_s)  # half the sampling rate: what stays real
        return np.fft.ifft(np.fft.fft(x) * turn) * np.exp(2j * np.pi * np.arange(len(x)) * k1 / n)

    def back(x: np.ndarray, n2: int, n: int, q: int) -> np.ndarray:
        return np.fft.ifft(x)

    one = _mapped(_gathered(met, keys, "n2", "n1"), keys, "n2", down)
    two = _mapped(_gathered(_spread(one, keys, "n2", "k1"), keys, "k1", "n2"), keys, "k1", across)
    three = _mapped(_gathered(_spread(two, keys, "k1", "n2"), keys, "n2", "k1"), keys, "n2", back)
    out = _spread(three, keys, "n2", "n1")
    return out.select(*keys, (F.col("n1") * F.col("q") + F.col("n2")).cast(kind).alias("n"), F.when(~F.isnan("re"), F.col("re")).alias(col))
