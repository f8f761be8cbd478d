"""Scalar rules shared by features, estimators and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_DOUBLE = "double"


def defined(x: Column) -> Column:
    """NaN and infinities become NULL, the only form of 'undefined' here."""
    x = x.cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bound a value; NULL stays NULL (NaN must be mapped by ``defined``)."""
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def impute_undefined(x: Column, value: float = 0.5) -> Column:
    return F.coalesce(x, F.lit(float(value)))


def score(est: Column, y: Column, fill: float = 0.5) -> Column:
    """Absolute error in percent of line length; undefined scores as ``fill``."""
    return F.abs(clip(impute_undefined(est, fill), 0.0, 1.0) - y) * 100.0


def score_defined(est: Column, y: Column) -> Column:
    """As :func:`score`, but undefined estimates leave the population."""
    return F.abs(clip(est, 0.0, 1.0) - y) * 100.0


def is_incipient(etype: Column) -> Column:
    return etype.contains("incipient")


def is_transient(etype: Column) -> Column:
    """Wider class than :func:`is_incipient`: also high-impedance faults."""
    return etype.rlike("incipient|hif")


def strip_prefix(etype: Column, prefix: str = "flt_") -> Column:
    return F.regexp_replace(etype, f"^{prefix}", "")


def lookup_by_name(names: list[str], chooser: Column, suffix: str = "") -> Column:
    """Value of the column called ``chooser + suffix`` (NULL if no such name)."""
    out = None
    for n in names:
        c = F.col(n + suffix)
        out = F.when(chooser == n, c) if out is None else out.when(chooser == n, c)
    return out


def argmin_columns(names: list[str], suffix: str = "") -> Column:
    """Name of the smallest defined column; the first one wins ties."""
    cells = [
        F.when(F.col(n + suffix).isNotNull(),
               F.struct(F.col(n + suffix).alias("v"), F.lit(i).alias("p"), F.lit(n).alias("name")))
        for i, n in enumerate(names)
    ]
    return F.array_min(F.array(*cells))["name"]


def bucketise(x: Column, edges: list[float], labels: list[str] | None = None,
              closed: str = "right") -> Column:
    """Interval label of ``x``; values outside all intervals give NULL."""
    if closed not in ("right", "left"):
        raise ValueError("closed must be 'right' or 'left'")
    labels = labels or [
        f"({a}, {b}]" if closed == "right" else f"[{a}, {b})" for a, b in zip(edges, edges[1:])
    ]
    out = None
    for a, b, lab in zip(edges, edges[1:], labels):
        inside = (x > a) & (x <= b) if closed == "right" else (x >= a) & (x < b)
        out = F.when(inside, F.lit(lab)) if out is None else out.when(inside, F.lit(lab))
    return out


def ladder(x: Column, tops: list[float], labels: list[str]) -> Column:
    """First label whose top is not exceeded; the last label takes the rest."""
    out = F.when(x <= tops[0], F.lit(labels[0]))
    for t, lab in zip(tops[1:], labels[1:]):
        out = out.when(x <= t, F.lit(lab))
    return out.when(x.isNotNull(), F.lit(labels[-1]))


def to_metres(err_pct: Column, length_km: Column) -> Column:
    return err_pct / 100.0 * length_km * 1000.0


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded value without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def rounded_double(x: Column, digits: int = 6) -> Column:
    """:func:`rounded` of a DOUBLE, the same in every bit, without a decimal number for each value.

    Spark rounds the shortest decimal text of a double. Unless the value is large or next to a tie, the whole number nearest to
    x * 10^digits is the same, and its quotient by that power is the double nearest to the decimal; the others take Spark's way.
    """
    scale = F.lit(10.0 ** digits)
    y = x * scale
    near = F.rint(y)
    plain = (F.abs(y) < 1e9) & (F.abs(y - near) < 0.499999)
    return F.when(plain, near / scale).otherwise(F.round(x, digits)) + F.lit(0.0)


def floor_to(x: Column, step: float) -> Column:
    """Largest multiple of ``step`` not above x, for 'at least' statements."""
    return F.floor(x / F.lit(step)) * F.lit(step)


def half_even_sample(start_s: Column, t0: float, fs: float) -> Column:
    return F.bround((start_s - t0) * fs, 0).cast("int")


def floor_sample(start_s: Column, t0: float, fs: float) -> Column:
    return F.floor((start_s - t0) * fs).cast("int")
