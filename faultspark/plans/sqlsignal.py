"""Brute-force SQL for the signal queries: no panes, no blocks.

Every window is expanded to its samples, every derivative to its 11-sample
fit, so the statements check the engine rather than repeat it.
"""

from __future__ import annotations

from faultspark.plans import sqlcx as q
from faultspark.plans.sqlviews import LINE_PARAMS, SIG

FS, N, HOP, WIN, GAP = 800, 16, 4, 40, 2
OMEGA = "(100 * pi())"
CH = ["ia", "ib", "ic", "va", "vb", "vc"]
LOOPS = ["ag", "bg", "cg", "ab", "bc", "ca"]

LEN = "len AS (SELECT rec, max(n) AS last_n FROM sig GROUP BY rec)"
WIN_ENDS = f"""w AS (SELECT rec, CAST(unnest(range({WIN}, last_n + 2, {HOP})) AS INTEGER) AS win_end FROM len)"""
WS = f"""wsx AS (SELECT rec, win_end, CAST(unnest(range(win_end - {WIN}, win_end)) AS INTEGER) AS n FROM w)"""


def deriv(src: str = "sig", key: str = "rec", cols=("ia", "ib", "ic"), name: str = "dv", half: int = 5) -> str:
    """Slope of the least-squares quadratic on the nearest 11 samples."""
    size = 2 * half + 1
    m2 = sum(k * k for k in range(-half, half + 1))
    q2 = sum((k * k - m2 / size) ** 2 for k in range(-half, half + 1))
    sums = ", ".join(
        f"{FS} * sum(b.{c} * ((x.m - x.c) / {m2}.0::DOUBLE + 2 * (x.n - x.c) * ((x.m - x.c) * (x.m - x.c) - {m2 / size}::DOUBLE) / {q2}::DOUBLE)) AS {c}_d"
        for c in cols)
    return f"""{name}_len AS (SELECT {key}, max(n) AS ln FROM {src} GROUP BY {key}),
{name}_c AS (SELECT s.{key}, s.n, least(greatest(s.n, {half}), l.ln - {half}) AS c FROM {src} s JOIN {name}_len l USING ({key})),
{name}_x AS (SELECT *, unnest(range(c - {half}, c + {half + 1})) AS m FROM {name}_c),
{name} AS (SELECT x.{key}, x.n, {sums} FROM {name}_x x JOIN {src} b ON b.{key} = x.{key} AND b.n = x.m GROUP BY x.{key}, x.n)"""


def dft(col: str, cond: str, alias: str) -> str:
    g = f"(2.0::DOUBLE / {N})"
    ang = f"(2 * pi() * (s.n % {N}) / {N})"
    return (f"{g} * sum(s.{col} * cos({ang})) FILTER ({cond}) AS {alias}_re, "
            f"-{g} * sum(s.{col} * sin({ang})) FILTER ({cond}) AS {alias}_im")


def phasors(prefix_last: str = "l_", prefix_first: str | None = "f_") -> str:
    out = [dft(c, f"s.n >= x.win_end - {N}", prefix_last + c) for c in CH]
    if prefix_first:
        out += [dft(c, f"s.n < x.win_end - {WIN - N}", prefix_first + c) for c in CH]
    return ",\n  ".join(out)


WINDOW_PHASORS = f"""wp AS (
  SELECT x.rec, x.win_end, {phasors()}
  FROM wsx x JOIN sig s ON s.rec = x.rec AND s.n = x.n GROUP BY x.rec, x.win_end)"""


def loop_stage() -> str:
    """wl: loop voltage, current, superimposed current and polariser."""
    i = [q.var(f"l_i{p}") for p in "abc"]
    v = [q.var(f"l_v{p}") for p in "abc"]
    z1, z0 = q.S("z1r", "z1x"), q.S("z0r", "z0x")
    base = dict(zip(("i0", "i1", "i2"), q.seq(*i))) | dict(zip(("v0", "v1", "v2"), q.seq(*v)))
    base |= {f"d{p}": q.var(f"l_i{p}") - q.var(f"f_i{p}") for p in "abc"}
    base["k0"] = (z0 - z1) / (z1 * 3)
    one, a, aa = q.const(1), q.A, q.AA
    rot = {"ag": one, "bg": aa, "cg": a, "ab": one - aa, "bc": aa - a, "ca": a - one}
    out = {}
    for lp in LOOPS:
        if lp[1] == "g":
            p = lp[0]
            out[f"V{lp}"] = q.var(f"l_v{p}")
            out[f"I{lp}"] = q.var(f"l_i{p}") + q.var("k0") * q.var("i0") * 3
            out[f"D{lp}"] = q.var(f"d{p}") + q.var("k0") * (q.var("da") + q.var("db") + q.var("dc"))
        else:
            p, r = lp
            out[f"V{lp}"] = q.var(f"l_v{p}") - q.var(f"l_v{r}")
            out[f"I{lp}"] = q.var(f"l_i{p}") - q.var(f"l_i{r}")
            out[f"D{lp}"] = q.var(f"d{p}") - q.var(f"d{r}")
        out[f"P{lp}"] = q.var("i2") / rot[lp]
    return q.staged("wl", "(SELECT * FROM wp JOIN lpt USING (rec))", [base, out])


def est(v: q.S, i: q.S, pol: q.S) -> str:
    num = (v * pol.conj()).im
    den = (q.S("z1r", "z1x") * i * pol.conj()).im
    return f"CASE WHEN abs({den}) > 1e-12 THEN {q.clip(f'({num} / nullif({den}, 0))', -1, 2)} ELSE 0.5 END"


def phasor_feature_list() -> list[str]:
    z1 = q.S("z1r", "z1x")
    out = []
    for lp in LOOPS:
        v, i = q.var(f"V{lp}"), q.var(f"I{lp}")
        z = (v / i) / z1
        live = f"{i.abs()} > 1e-9"
        pick = lambda x, other: f"CASE WHEN {live} THEN {x} ELSE {other} END"  # noqa: E731,B023
        out += [f"{pick(q.clip(z.re, -5, 5), 0.0)} AS {lp}_zr", f"{pick(q.clip(z.im, -5, 5), 0.0)} AS {lp}_zi",
                f"{pick(q.clip(f'({(v / i).im} / z1x)', -1, 2), 0.5)} AS {lp}_react",
                f"{pick(f'least({z.abs()}, 10)', 0.0)} AS {lp}_absz",
                f"{est(v, i, q.var(f'P{lp}'))} AS {lp}_tak2", f"{est(v, i, q.var(f'D{lp}'))} AS {lp}_takd"]
        if lp[1] == "g":
            out.append(f"CASE WHEN {q.var('i0').abs()} / ({q.var('i1').abs()} + 1e-9) < 1e-6 THEN 0.5 "
                       f"ELSE {est(v, i, q.var('i0') * 3)} END AS {lp}_tak0")
    for s in ("i0", "i2", "v0", "v2"):
        out.append(f"{q.var(s).abs()} / ({q.var(s[0] + '1').abs()} + 1e-9) AS {s}r")
    rel = {s: f"({q.var(s).arg()} - {q.var('i1').arg()})" for s in ("i2", "i0")}
    out += [f"cos({rel['i2']}) AS i2c", f"sin({rel['i2']}) AS i2s"]
    small = f"{q.var('i0').abs()} / ({q.var('i1').abs()} + 1e-9) < 1e-6"
    out += [f"CASE WHEN {small} THEN 0.0 ELSE cos({rel['i0']}) END AS i0c",
            f"CASE WHEN {small} THEN 0.0 ELSE sin({rel['i0']}) END AS i0s"]
    top = "greatest(" + ", ".join(q.var(f"l_i{p}").abs() for p in "abc") + ")"
    for p in "abc":
        li, fi = q.var(f"l_i{p}").abs(), q.var(f"f_i{p}").abs()
        lv, fv = q.var(f"l_v{p}").abs(), q.var(f"f_v{p}").abs()
        out += [f"least({li} / ({fi} + 1e-9), 100) AS i{p}_onset", f"least({lv} / ({fv} + 1e-9), 5) AS v{p}_drop",
                f"{li} / ({top} + 1e-9) AS i{p}_share", f"least({q.var(f'd{p}').abs()} / ({fi} + 1e-9), 100) AS di{p}_rel"]
    return out


def td_stage() -> str:
    """Loop signals per sample, then the six fit sums per window."""
    l1, l0 = f"(z1x / {OMEGA})", f"(z0x / {OMEGA})"
    sel, sums = [], []
    for lp in LOOPS:
        if lp[1] == "g":
            p = lp[0]
            sel += [f"s.v{p} AS v_{lp}",
                    f"z1r * s.i{p} + {l1} * d.i{p}_d + (z0r - z1r) * (s.ia + s.ib + s.ic) / 3 + ({l0} - {l1}) * (d.ia_d + d.ib_d + d.ic_d) / 3 AS u_{lp}",
                    f"s.i{p} - b.i{p} AS g_{lp}"]
        else:
            p, r = lp
            sel += [f"s.v{p} - s.v{r} AS v_{lp}", f"z1r * (s.i{p} - s.i{r}) + {l1} * (d.i{p}_d - d.i{r}_d) AS u_{lp}",
                    f"(s.i{p} - b.i{p}) - (s.i{r} - b.i{r}) AS g_{lp}"]
        for a, b in ("vv", "uu", "gg", "vu", "vg", "ug"):
            sums.append(f"sum({a}_{lp} * {b}_{lp}) FILTER (x.n >= x.win_end - {WIN - N}) AS {a}{b}_{lp}")
    return f"""{deriv()},
lsig AS (SELECT s.rec, s.n, {', '.join(sel)} FROM sig s JOIN dv d USING (rec, n) JOIN lpt USING (rec)
         LEFT JOIN sig b ON b.rec = s.rec AND b.n = s.n - {N}),
wt AS (SELECT x.rec, x.win_end, {', '.join(sums)} FROM wsx x JOIN lsig s ON s.rec = x.rec AND s.n = x.n GROUP BY x.rec, x.win_end)"""


def td_feature_list() -> list[str]:
    out = []
    for lp in LOOPS:
        vv, uu, gg, vu, vg, ug = (f"{s}_{lp}" for s in ("vv", "uu", "gg", "vu", "vg", "ug"))
        det = f"({uu} * {gg} - {ug} * {ug})"
        b0 = f"(({vu} * {gg} - {vg} * {ug}) / nullif({det}, 0))"
        b1 = f"(({vg} * {uu} - {vu} * {ug}) / nullif({det}, 0))"
        rest = f"greatest({vv} - {b0} * {vu} - {b1} * {vg}, 0)"
        out += [f"{q.clip(b0, -1, 2)} AS {lp}_dtd", f"{q.clip(f'({vu} / ({uu} + 1e-12))', -1, 2)} AS {lp}_drl",
                f"least(sqrt({rest}) / (sqrt({vv}) + 1e-12), 5) AS {lp}_tdres"]
    return out


BASE = [SIG, LINE_PARAMS, LEN, WIN_ENDS, WS]


def features_cte(td: bool = True, phasor: bool = True) -> list[str]:
    """Views ending in ``feat`` (rec, win_end, features)."""
    views = list(BASE)
    if phasor:
        views += [WINDOW_PHASORS, loop_stage(),
                  f"fp AS (SELECT rec, win_end, {', '.join(phasor_feature_list())} FROM wl)"]
    if td:
        views += [td_stage(), f"ft AS (SELECT rec, win_end, {', '.join(td_feature_list())} FROM wt)"]
    src = "fp JOIN ft USING (rec, win_end)" if td and phasor else ("fp" if phasor else "ft")
    return views + [f"feat AS (SELECT * FROM {src})"]


def modal_cte(deriv_cols: str = "quadratic") -> list[str]:
    """Views ending in ``uw`` (line, n, u_al, u_be, w_al, w_be)."""
    def mode(pre: str, s: str) -> str:
        return (f"(2 * {pre}.i{'a'} - {pre}.ib - {pre}.ic) / 3.0::DOUBLE AS i{s}_al, ({pre}.ib - {pre}.ic) / sqrt(3.0::DOUBLE) AS i{s}_be, "
                f"(2 * {pre}.va - {pre}.vb - {pre}.vc) / 3.0::DOUBLE AS v{s}_al, ({pre}.vb - {pre}.vc) / sqrt(3.0::DOUBLE) AS v{s}_be")
    views = [SIG, LINE_PARAMS,
             "lpl AS (SELECT rec // 2 AS line, * EXCLUDE (rec) FROM lpt WHERE rec % 2 = 0)",
             f"""md AS (SELECT a.rec // 2 AS line, a.n, {mode('a', 's')}, {mode('b', 'r')}
                 FROM sig a JOIN sig b ON b.rec = a.rec + 1 AND b.n = a.n WHERE a.rec % 2 = 0)"""]
    dcols = ("is_al", "is_be", "ir_al", "ir_be")
    if deriv_cols == "quadratic":
        views.append(deriv("md", "line", dcols, "mdd"))
    else:
        def cen(c):
            o = "(PARTITION BY line ORDER BY n)"
            return (f"CASE WHEN lead({c}) OVER {o} IS NULL THEN ({c} - lag({c}) OVER {o}) * {FS} "
                    f"WHEN lag({c}) OVER {o} IS NULL THEN (lead({c}) OVER {o} - {c}) * {FS} "
                    f"ELSE (lead({c}) OVER {o} - lag({c}) OVER {o}) * {FS} / 2.0 END AS {c}_d")
        views.append("mdd AS (SELECT line, n, " + ", ".join(cen(c) for c in dcols) + " FROM md)")
    return views


def uw_cte(r: str = "z1r", l_h: str = f"(z1x / {OMEGA})") -> str:
    parts = []
    for m in ("al", "be"):
        parts.append(f"vs_{m} - vr_{m} + {r} * ir_{m} + {l_h} * ir_{m}_d AS u_{m}, "
                     f"{r} * (is_{m} + ir_{m}) + {l_h} * (is_{m}_d + ir_{m}_d) AS w_{m}")
    return f"uw AS (SELECT line, n, {', '.join(parts)} FROM md JOIN mdd USING (line, n) JOIN lpl USING (line))"


TD_WINDOWS = f"""lw AS (SELECT line, CAST(unnest(range({WIN}, last_n + 2, {HOP})) AS INTEGER) AS win_end FROM (SELECT line, max(n) AS last_n FROM uw GROUP BY line)),
lwx AS (SELECT line, win_end, CAST(unnest(range(win_end - {WIN}, win_end)) AS INTEGER) AS n FROM lw),
td AS (SELECT x.line, x.win_end, sum(u_al * w_al + u_be * w_be) AS uw, sum(w_al * w_al + w_be * w_be) AS ww,
              sum(u_al * w_al + u_be * w_be) / (sum(w_al * w_al + w_be * w_be) + 1e-12) AS td_est
       FROM lwx x JOIN uw USING (line, n) GROUP BY x.line, x.win_end)"""


def td_cte(deriv_cols: str = "quadratic", r: str = "z1r", l_h: str = f"(z1x / {OMEGA})") -> list[str]:
    return modal_cte(deriv_cols) + [uw_cte(r, l_h), TD_WINDOWS]
