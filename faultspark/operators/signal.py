"""Sample-level transforms. All window functions run inside halo blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultspark.config import SignalConfig
from faultspark.functions import draws
from faultspark.functions.scalar import defined

CURRENTS = ["ia", "ib", "ic"]
VOLTAGES = ["va", "vb", "vc"]
CHANNELS = CURRENTS + VOLTAGES


def in_order(part: list[str], n: str = "n"):
    return Window.partitionBy(*part).orderBy(n)


def clarke_alpha(a: Column, b: Column, c: Column) -> Column:
    return (a * 2.0 - b - c) / 3.0


def clarke_beta(b: Column, c: Column) -> Column:
    return (b - c) / F.lit(math.sqrt(3.0))


def deriv_central(df: DataFrame, cols: list[str], part: list[str], cfg: SignalConfig,
                  n: str = "n", suffix: str = "_d") -> DataFrame:
    """Central differences, one-sided at the two ends of the record."""
    w = in_order(part, n)
    out = {}
    for c in cols:
        x, nxt, prv = F.col(c), F.lead(c, 1).over(w), F.lag(c, 1).over(w)
        out[c + suffix] = (
            F.when(nxt.isNotNull() & prv.isNotNull(), (nxt - prv) * (cfg.fs / 2.0))
            .when(nxt.isNotNull(), (nxt - x) * cfg.fs)
            .when(prv.isNotNull(), (x - prv) * cfg.fs)
        )
    return df.withColumns(out)


def deriv_quadratic(df: DataFrame, cols: list[str], part: list[str], cfg: SignalConfig,
                    n: str = "n", suffix: str = "_d") -> DataFrame:
    """Derivative of the quadratic least-squares fit on 2h+1 samples.

    Inside the record this is a symmetric FIR filter. The first and last h
    samples take the slope of the fit on the first / last 2h+1 samples, i.e.
    ``b + 2*c*k`` at offset k from the centre of that fit. Gaps in ``n`` give
    NULL.
    """
    h = cfg.fir_half
    size = 2 * h + 1
    m2 = float(sum(k * k for k in range(-h, h + 1)))
    mean2 = m2 / size
    q2 = sum((k * k - mean2) ** 2 for k in range(-h, h + 1))
    by = ", ".join(part)
    near = f"OVER (PARTITION BY {by} ORDER BY {n} RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    whole = f"OVER (PARTITION BY {by})"
    # Positions relative to the block keep the moving sums well scaled.
    origin = f"blk * {cfg.block}" if "blk" in part else "0"
    df = df.withColumn("_m", F.expr(f"CAST({n} - {origin} AS DOUBLE)"))
    stage = {"_cnt": f"count({n}) {near}", "_last": f"max({n}) {whole}"}
    for c in cols:
        stage[f"_s_{c}"] = f"sum({c}) {near}"
        stage[f"_p_{c}"] = f"sum({c} * _m) {near}"
    df = df.withColumns({k: F.expr(v) for k, v in stage.items()})
    offset = {"0": f"({n} - {h})", "1": f"({n} - _last + {h})"}
    inside = {"0": f"{n} < {size}", "1": f"{n} > _last - {size}"}
    edges = {}
    for side, k in offset.items():
        edges[f"_k{side}"] = f"count(CASE WHEN {inside[side]} THEN {n} END) {whole}"
        for c in cols:
            x = f"CASE WHEN {inside[side]} THEN {c}"
            edges[f"_b{side}_{c}"] = f"sum({x} * {k} END) {whole}"
            edges[f"_c{side}_{c}"] = f"sum({x} * ({k} * {k} - {mean2!r}D) END) {whole}"
    df = df.withColumns({k: F.expr(v) for k, v in edges.items()})
    out = {}
    for c in cols:
        fit = {s: f"CASE WHEN _k{s} = {size} THEN _b{s}_{c} / {m2!r}D + _c{s}_{c} * {2.0 / q2!r}D * {k} END" for s, k in offset.items()}
        out[c + suffix] = F.expr(
            f"{cfg.fs!r}D * CASE WHEN _cnt = {size} THEN (_p_{c} - _m * _s_{c}) / {m2!r}D "
            f"WHEN {n} < {h} THEN {fit['0']} WHEN {n} > _last - {h} THEN {fit['1']} END")
    return df.withColumns(out).drop("_m", *stage, *edges)


DERIVATIVES = {"quadratic": deriv_quadratic, "central": deriv_central}


def delta_cycle(df: DataFrame, cols: list[str], part: list[str], cfg: SignalConfig,
                n: str = "n", suffix: str = "_g") -> DataFrame:
    """x(n) - x(n - cycle); NULL where the earlier sample is missing."""
    w = in_order(part, n)
    ok = F.lag(n, cfg.cycle).over(w) == F.col(n) - cfg.cycle
    return df.withColumns(
        {c + suffix: F.when(ok, F.col(c) - F.lag(c, cfg.cycle).over(w)) for c in cols})


def pair_terminals(blocked: DataFrame, keys: list[str], cols: list[str], term: str = "term",
                   blk: str = "blk", n: str = "n") -> DataFrame:
    """Bring the remote terminal's sample next to the local one.

    Both terminals of a line share (keys, block), so this is one ordered pass
    and no join. Local columns keep their names, remote ones get ``r_``.
    """
    w = Window.partitionBy(*keys, blk).orderBy(n, term)
    nxt = {f"r_{c}": F.lead(c, 1).over(w) for c in cols}
    return (blocked.withColumns({**nxt, "_rn": F.lead(n, 1).over(w), "_rt": F.lead(term, 1).over(w)})
            .where((F.col(term) == 0) & (F.col("_rt") == 1) & (F.col("_rn") == F.col(n)))
            .drop(term, "_rn", "_rt"))


def modal_inputs(pairs: DataFrame) -> DataFrame:
    """Aerial-mode voltages difference and currents of both ends."""
    c = F.col
    out = {}
    for s, pre in (("s", ""), ("r", "r_")):
        i = [c(pre + x) for x in CURRENTS]
        v = [c(pre + x) for x in VOLTAGES]
        out[f"i{s}_al"], out[f"i{s}_be"] = clarke_alpha(*i), clarke_beta(i[1], i[2])
        out[f"v{s}_al"], out[f"v{s}_be"] = clarke_alpha(*v), clarke_beta(v[1], v[2])
    drop = CHANNELS + [f"r_{x}" for x in CHANNELS]
    return pairs.withColumns(out).drop(*drop)


MODES = ("al", "be")


def modal_uw(df: DataFrame, r: Column, l_h: Column) -> DataFrame:
    """Per mode: u = vS - vR + R iR + L iR', w = R (iS+iR) + L (iS'+iR')."""
    c = F.col
    out = {}
    for m in MODES:
        out[f"u_{m}"] = c(f"vs_{m}") - c(f"vr_{m}") + r * c(f"ir_{m}") + l_h * c(f"ir_{m}_d")
        out[f"w_{m}"] = (r * (c(f"is_{m}") + c(f"ir_{m}"))
                         + l_h * (c(f"is_{m}_d") + c(f"ir_{m}_d")))
    return df.withColumns(out)


def rms_prefix(samples: DataFrame, keys: list[str], cols: list[str], seconds: float,
               cfg: SignalConfig) -> DataFrame:
    """RMS of the first ``seconds`` of each record (combined map-side)."""
    head = samples.where(F.col("n") < int(seconds * cfg.fs))
    return head.groupBy(*keys).agg(
        *[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rms_{c}") for c in cols])


def add_noise(samples: DataFrame, keys: list[str], cols: list[str], snr_db: float, seed: int,
              cfg: SignalConfig, seconds: float = 0.09, portable: bool = False) -> DataFrame:
    """White noise at ``snr_db`` below each channel's leading RMS.

    The draw depends only on (seed, key, channel, n); ``portable`` draws by
    MD5, as another SQL engine can. The per-record RMS table
    is joined on the record key; AQE broadcasts it when it is small and splits
    hot records otherwise.
    """
    rms = rms_prefix(samples, keys, cols, seconds, cfg)
    gain = 10.0 ** (-snr_db / 20.0)
    noisy = samples.join(rms, keys)

    def normal(c: str) -> Column:
        if portable:
            return draws.normal(seed, F.concat_ws(":", *[F.col(k) for k in keys]), c, F.col("n"))
        return draws.fast_normal(seed, *[F.col(k) for k in keys], c, F.col("n"))

    out = {c: F.col(c) + (F.col(f"rms_{c}") + 1e-12) * gain * normal(c) for c in cols}
    return noisy.withColumns(out).drop(*[f"rms_{c}" for c in cols])


def shift_record(samples: DataFrame, keys: list[str], k: int, wrap: bool = True) -> DataFrame:
    """Circular shift: sample n moves to (n + k) mod length.

    With ``wrap=False`` the samples that would wrap are dropped.
    """
    size = samples.groupBy(*keys).agg((F.max("n") + 1).alias("_len"))
    moved = samples.join(size, keys).withColumn("_n", F.col("n") + k)
    if not wrap:
        moved = moved.where((F.col("_n") >= 0) & (F.col("_n") < F.col("_len")))
    return moved.withColumn("n", F.pmod("_n", "_len")).drop("_n", "_len")


def exceed_flags(samples: DataFrame, windows: DataFrame, keys: list[str], pairs: list[tuple[str, str]],
                 cfg: SignalConfig, threshold: float = 0.05) -> DataFrame:
    """Flag windows where max|x| > threshold * max|y| on any (x, y) pair."""
    from faultspark.operators.windows import pane_table, roll_panes

    aggs = {}
    for x, y in pairs:
        aggs[f"mx_{x}"] = F.max(F.abs(F.col(x)))
        aggs[f"my_{y}"] = F.max(F.abs(F.col(y)))
    panes = pane_table(samples.select(*keys, "n", *{c for p in pairs for c in p}), keys, aggs, cfg)
    rolled = roll_panes(panes, keys, {a: ("max", a, -(cfg.win_panes - 1), 0) for a in aggs}, cfg)
    flag = F.lit(False)
    for x, y in pairs:
        flag = flag | (F.col(f"mx_{x}") > F.col(f"my_{y}") * threshold)
    return (rolled.join(windows, [*keys, "win_end"])
            .select(*windows.columns, F.coalesce(flag, F.lit(False)).cast("int").alias("sat")))


def with_scales(df: DataFrame, scales: list[tuple[str, float, float]]) -> DataFrame:
    """One copy of each row per named (R, L) scale; the list is a literal."""
    cells = [F.struct(F.lit(n).alias("scale"), F.lit(float(a)).alias("scale_r"),
                      F.lit(float(b)).alias("scale_l")) for n, a, b in scales]
    return df.select("*", F.inline(F.array(*cells)))
