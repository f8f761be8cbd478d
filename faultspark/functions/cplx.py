"""Complex numbers as pairs of DOUBLE columns.

Spark has no complex type. ``Cx`` keeps the two parts as SQL expressions (or
Columns), so the algebra stays inside generated code and a long formula costs
one call into the JVM. Operators that reuse a complex value many times first
materialise it with :func:`put`, which keeps expression trees small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = complex(-0.5, math.sqrt(3.0) / 2.0)


def lit_text(x: float) -> str:
    return f"({float(x)!r}D)"


def as_column(x) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def _op(sign: str, a, b):
    """a sign b, as text while both sides are text."""
    if isinstance(a, str) and isinstance(b, str):
        return f"({a} {sign} {b})"
    a, b = as_column(a), as_column(b)
    return {"+": a + b, "-": a - b, "*": a * b}[sign]


def _ratio(a, b):
    if isinstance(a, str) and isinstance(b, str):
        return f"try_divide({a}, {b})"
    return F.try_divide(as_column(a), as_column(b))


class Cx:
    """Complex value; ``re`` and ``im`` are Columns."""

    def __init__(self, re, im):
        self.x, self.y = re, im

    @property
    def re(self) -> Column:
        return as_column(self.x)

    @property
    def im(self) -> Column:
        return as_column(self.y)

    def __add__(self, o):
        o = lift(o)
        return Cx(_op("+", self.x, o.x), _op("+", self.y, o.y))

    def __radd__(self, o):
        return self + o

    def __sub__(self, o):
        o = lift(o)
        return Cx(_op("-", self.x, o.x), _op("-", self.y, o.y))

    def __rsub__(self, o):
        return lift(o) - self

    def __neg__(self):
        return self * -1.0

    def __mul__(self, o):
        if isinstance(o, (int, float)):
            o = lit_text(o)
        if isinstance(o, (str, Column)):
            return Cx(_op("*", self.x, o), _op("*", self.y, o))
        o = lift(o)
        return Cx(_op("-", _op("*", self.x, o.x), _op("*", self.y, o.y)),
                  _op("+", _op("*", self.x, o.y), _op("*", self.y, o.x)))

    def __rmul__(self, o):
        return self * o

    def __truediv__(self, o):
        """Quotient; NULL parts when the divisor is exactly zero."""
        if isinstance(o, (int, float)):
            o = lit_text(o)
        if isinstance(o, (str, Column)):
            return Cx(_ratio(self.x, o), _ratio(self.y, o))
        o = lift(o)
        n, p = o._norm2(), self * o.conj()
        return Cx(_ratio(p.x, n), _ratio(p.y, n))

    def conj(self):
        return Cx(self.x, _op("*", self.y, lit_text(-1.0)))

    def _norm2(self):
        return _op("+", _op("*", self.x, self.x), _op("*", self.y, self.y))

    def norm2(self) -> Column:
        return as_column(self._norm2())

    def abs(self) -> Column:
        n = self._norm2()
        return F.expr(f"sqrt({n})") if isinstance(n, str) else F.sqrt(n)

    def arg(self) -> Column:
        if isinstance(self.x, str) and isinstance(self.y, str):
            return F.expr(f"atan2({self.y}, {self.x})")
        return F.atan2(self.im, self.re)

    def turn(self, theta: Column):
        """Multiply by exp(-j*theta)."""
        return self * Cx(F.cos(theta), -F.sin(theta))


def lift(x) -> Cx:
    if isinstance(x, Cx):
        return x
    if isinstance(x, (str, Column)):
        return Cx(x, lit_text(0.0))
    z = complex(x)
    return Cx(lit_text(z.real), lit_text(z.imag))


def cx(name: str) -> Cx:
    return Cx(f"{name}_re", f"{name}_im")


def parts(values: dict[str, Cx]) -> dict[str, Column]:
    out = {}
    for k, v in values.items():
        out[f"{k}_re"], out[f"{k}_im"] = v.re, v.im
    return out


def put(df: DataFrame, values: dict[str, Cx]) -> DataFrame:
    """Materialise complex values as ``<name>_re`` and ``<name>_im``."""
    return df.withColumns(parts(values))


def zero_seq(a: Cx, b: Cx, c: Cx) -> Cx:
    return (a + b + c) * (1.0 / 3.0)


def pos_seq(a: Cx, b: Cx, c: Cx) -> Cx:
    return (a + b * ALPHA + c * ALPHA.conjugate()) * (1.0 / 3.0)


def neg_seq(a: Cx, b: Cx, c: Cx) -> Cx:
    return (a + b * ALPHA.conjugate() + c * ALPHA) * (1.0 / 3.0)


def wrap_angle(x: Column) -> Column:
    return F.atan2(F.sin(x), F.cos(x))
