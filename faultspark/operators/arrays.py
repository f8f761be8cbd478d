"""Operators on fixed-length record arrays.

Delay and recursive filtering are sequential or global in time, so they run on
array rows: Spark partitions the rows, NumPy works on one Arrow batch at a time.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def _map_arrays(df: DataFrame, col: str, fn) -> DataFrame:
    """Apply fn(matrix) to equal-length groups of rows of each batch."""
    schema = StructType([StructField(f.name, ArrayType(DoubleType()) if f.name == col else f.dataType)
                         for f in df.schema.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            out = [None] * len(pdf)
            for size, idx in pdf[col].map(len).groupby(pdf[col].map(len)).groups.items():
                rows = pdf.index.get_indexer(idx)
                if size:
                    block = np.stack([np.asarray(pdf[col].iloc[i], dtype=float) for i in rows])
                    for i, r in zip(rows, fn(block)):
                        out[i] = r
                else:
                    for i in rows:
                        out[i] = []
            yield pdf.assign(**{col: out})

    return df.mapInPandas(run, schema)


def fractional_delay(df: DataFrame, col: str, tau_s: float, fs: float) -> DataFrame:
    """Circular delay by a phase shift of the whole record's spectrum."""
    def delay(x):
        import numpy as np

        f = np.fft.rfftfreq(x.shape[1], 1.0 / fs)
        return np.fft.irfft(np.fft.rfft(x, axis=1) * np.exp(-2j * np.pi * f * tau_s), n=x.shape[1], axis=1)

    return _map_arrays(df, col, delay)


def butterworth2(fc: float, fs: float) -> tuple[list[float], list[float]]:
    """Second-order low-pass by the bilinear transform with prewarping."""
    k = math.tan(math.pi * fc / fs)
    n = 1.0 / (1.0 + math.sqrt(2.0) * k + k * k)
    return [k * k * n, 2 * k * k * n, k * k * n], [1.0, 2 * (k * k - 1) * n, (1 - math.sqrt(2.0) * k + k * k) * n]


def resonant2(tau_s: float, f0: float, fs: float) -> tuple[list[float], list[float]]:
    """Bilinear form of (2/tau)s / (s^2 + (2/tau)s + w0^2), no prewarping."""
    c, g, w2 = 2.0 * fs, 2.0 / tau_s, (2 * math.pi * f0) ** 2
    a0 = c * c + g * c + w2
    return [g * c / a0, 0.0, -g * c / a0], [1.0, 2 * (w2 - c * c) / a0, (c * c - g * c + w2) / a0]


def gain_at(b: list[float], a: list[float], f: float, fs: float) -> complex:
    z = cmath.exp(-2j * math.pi * f / fs)
    return sum(x * z ** k for k, x in enumerate(b)) / sum(x * z ** k for k, x in enumerate(a))


def recursive_filter(df: DataFrame, col: str, b: list[float], a: list[float], cycle: int, pad: int) -> DataFrame:
    """Causal second-order filter started from steady state.

    The first cycle is repeated for ``pad`` samples (whole cycles) before the
    record and dropped afterwards. All rows of a batch advance together.
    """
    reps = pad // cycle

    def run(x):
        import numpy as np

        z = np.concatenate([np.tile(x[:, :cycle], (1, reps)), x], axis=1)
        y = np.zeros_like(z)
        s1, s2 = np.zeros(len(z)), np.zeros(len(z))
        for n in range(z.shape[1]):
            y[:, n] = b[0] * z[:, n] + s1
            s1 = b[1] * z[:, n] - a[1] * y[:, n] + s2
            s2 = b[2] * z[:, n] - a[2] * y[:, n]
        return y[:, reps * cycle:]

    return _map_arrays(df, col, run)


def shift_array(x: Column, k: int) -> Column:
    """Circular shift of an array: element n moves to (n + k) mod length."""
    k_ = F.pmod(F.lit(k), F.size(x))
    return F.concat(F.slice(x, F.size(x) - k_ + 1, k_), F.slice(x, F.lit(1), F.size(x) - k_))


def to_samples(df: DataFrame, keys: list[str], col: str, out: str = "x") -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("n", out))


def slice_windows(df: DataFrame, col: str, win: int, hop: int) -> DataFrame:
    """All complete hop windows of an array column."""
    ends = F.sequence(F.lit(win), F.size(col), F.lit(hop))
    return (df.where(F.size(col) >= win).select("*", F.explode(ends).alias("win_end"))
            .withColumn(col, F.slice(F.col(col), F.col("win_end") - win + 1, win)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, accumulated in DOUBLE."""
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)


def normalise_rms(df: DataFrame, u: list[str], w: list[str]) -> DataFrame:
    """Divide a window's arrays by the joint RMS of the ``w`` arrays."""
    energy = sum((dot(F.col(c), F.col(c)) for c in w[1:]), dot(F.col(w[0]), F.col(w[0])))
    count = sum((F.size(c) for c in w[1:]), F.size(w[0]))
    d = df.withColumn("_rms", F.sqrt(energy / count) + 1e-12)
    return d.withColumns({c: F.transform(F.col(c).cast("array<double>"), lambda x: x / F.col("_rms"))
                          for c in (*u, *w)}).drop("_rms")


def recheck_estimate(df: DataFrame, u: list[str], w: list[str], stored: str) -> DataFrame:
    """Estimate recomputed from stored modal windows and its deviation."""
    num = sum((dot(F.col(a), F.col(b)) for a, b in list(zip(u, w))[1:]), dot(F.col(u[0]), F.col(w[0])))
    den = sum((dot(F.col(b), F.col(b)) for b in w[1:]), dot(F.col(w[0]), F.col(w[0])))
    est = num / (den + 1e-12)
    return df.withColumns({"recomputed": est, "abs_dev": F.abs(est - F.col(stored))})
