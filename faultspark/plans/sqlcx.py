"""Complex algebra as SQL text, for the side-by-side statements."""

from __future__ import annotations

from typing import NamedTuple


class S(NamedTuple):
    """Real and imaginary part as SQL expressions."""

    re: str
    im: str

    def __add__(self, o):
        return S(f"({self.re} + {o.re})", f"({self.im} + {o.im})")

    def __sub__(self, o):
        return S(f"({self.re} - {o.re})", f"({self.im} - {o.im})")

    def __mul__(self, o):
        if not isinstance(o, S):
            return S(f"({self.re} * {o})", f"({self.im} * {o})")
        return S(f"({self.re} * {o.re} - {self.im} * {o.im})", f"({self.re} * {o.im} + {self.im} * {o.re})")

    def __truediv__(self, o):
        n = f"nullif({o.re} * {o.re} + {o.im} * {o.im}, 0)"
        return S(f"(({self.re} * {o.re} + {self.im} * {o.im}) / {n})",
                 f"(({self.im} * {o.re} - {self.re} * {o.im}) / {n})")

    def conj(self):
        return S(self.re, f"(-{self.im})")

    def abs(self):
        return f"sqrt({self.re} * {self.re} + {self.im} * {self.im})"

    def arg(self):
        return f"atan2({self.im}, {self.re})"


def const(z: complex) -> S:
    return S(f"({z.real!r}::DOUBLE)", f"({z.imag!r}::DOUBLE)")


def var(name: str) -> S:
    return S(f"{name}_re", f"{name}_im")


ROOT3 = "(sqrt(3.0::DOUBLE) / 2)"
A = S("(-0.5::DOUBLE)", ROOT3)
AA = S("(-0.5::DOUBLE)", f"(-{ROOT3})")


def cols(values: dict[str, S]) -> str:
    """Select list; DuckDB lets later items use earlier aliases."""
    return ",\n  ".join(f"{v.re} AS {k}_re, {v.im} AS {k}_im" for k, v in values.items())


def seq(a: S, b: S, c: S) -> tuple[S, S, S]:
    third = "(1.0::DOUBLE / 3)"
    return ((a + b + c) * third, (a + A * b + AA * c) * third, (a + AA * b + A * c) * third)


def clip(x: str, lo, hi) -> str:
    return f"CASE WHEN {x} < {lo} THEN {lo}::DOUBLE WHEN {x} > {hi} THEN {hi}::DOUBLE ELSE {x} END"


def staged(name: str, src: str, stages: list, where: str = "") -> str:
    """Chain of views, one per stage, so that no alias is expanded twice.

    A stage is a dict of complex values or a list of "expr AS alias" items.
    """
    out = []
    for k, st in enumerate(stages):
        items = cols(st) if isinstance(st, dict) else ", ".join(st)
        this = name if k == len(stages) - 1 else f"{name}_s{k}"
        out.append(f"{this} AS MATERIALIZED (SELECT *, {items} FROM {src} {where if k == 0 else ''})")
        src = this
    return ",\n".join(out)
