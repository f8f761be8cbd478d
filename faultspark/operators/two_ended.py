"""Two-ended estimators: synchronised samples of both line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.config import SignalConfig
from faultspark.functions.cplx import Cx, cx, pos_seq
from faultspark.operators import lines, signal, windows
from faultspark.operators.blocks import block_params, halo_blocks

#: Factor pairs of the two modal sums, independent of R and L.
A_TERMS = ("dv", "ir", "ird")
B_TERMS = ("is", "isd")


def modal_samples(samples: DataFrame, keys: list[str], cfg: SignalConfig, deriv: str = "quadratic") -> DataFrame:
    """Modal currents, voltages and current derivatives in halo blocks."""
    part = [*keys, "blk"]
    pairs = signal.pair_terminals(halo_blocks(samples, cfg), keys, signal.CHANNELS)
    modal = signal.modal_inputs(pairs)
    currents = [f"i{s}_{m}" for s in "sr" for m in signal.MODES]
    return signal.DERIVATIVES[deriv](modal, currents, part, cfg)


def raw_windows(samples: DataFrame, params: DataFrame, wanted: DataFrame, keys: list[str], cfg: SignalConfig,
                deriv: str = "quadratic") -> DataFrame:
    """Raw windows of both ends: twelve channels (``s_``, ``r_``) and u, w of both modes, as FLOAT arrays."""
    part = [*keys, "blk"]
    pairs = signal.pair_terminals(halo_blocks(samples, cfg), keys, signal.CHANNELS)
    kept = {f"{tag}_{x}": F.col(x if tag == "s" else f"r_{x}") for tag in "sr" for x in signal.CHANNELS}
    rows = pairs.select("*", *[v.alias(f"_{k}") for k, v in kept.items()])
    modal = signal.DERIVATIVES[deriv](signal.modal_inputs(rows), [f"i{s}_{m}" for s in "sr" for m in signal.MODES], part, cfg)
    modal = modal.join(block_params(wanted, params.select(*keys, "z1r", "z1x"), keys, cfg), part)
    uw = signal.modal_uw(modal, F.col("z1r"), F.col("z1x") / cfg.omega)
    modes = [f"{q}_{m}" for q in "uw" for m in signal.MODES]
    rows = uw.select(*part, "n", *[F.col(f"_{k}").alias(k) for k in kept], *modes)
    return windows.raw_windows(rows, wanted, keys, [*kept, *modes], cfg, "blk")


def ratio(num: Column, den: Column) -> Column:
    return num / (den + 1e-12)


def td_sums(samples: DataFrame, keys: list[str], cfg: SignalConfig, deriv: str = "quadratic") -> DataFrame:
    """Window sums of the products of u's and w's parts, free of R and L: (keys, win_end, sums).

    u and w are linear in (R, L), so parameters meet windows, not samples.
    """
    part = [*keys, "blk"]
    c = F.col
    df = modal_samples(samples, keys, cfg, deriv)
    prods = {}
    for m in signal.MODES:
        a = {"dv": c(f"vs_{m}") - c(f"vr_{m}"), "ir": c(f"ir_{m}"), "ird": c(f"ir_{m}_d")}
        b = {"is": c(f"is_{m}") + c(f"ir_{m}"), "isd": c(f"is_{m}_d") + c(f"ir_{m}_d")}
        for p, x in a.items():
            for q, y in b.items():
                prods.setdefault(f"{p}_{q}", []).append(x * y)
        for name, v in (("bb", b["is"] * b["is"]), ("bd", b["is"] * b["isd"]), ("dd", b["isd"] * b["isd"])):
            prods.setdefault(name, []).append(v)
    flat = df.select(*part, "n", *[sum(v[1:], v[0]).alias(k) for k, v in prods.items()])
    panes = windows.pane_table(flat, part, {k: F.sum(k) for k in prods}, cfg, require=c("ird_isd"))
    k = cfg.win_panes - 1
    return windows.roll_panes(panes, part, {p: ("sum", p, -k, 0) for p in prods}, cfg, blk="blk")


def td_project(sums: DataFrame, r: Column, l_h: Column) -> DataFrame:
    """Add uw, ww and td_est = sum(u*w) / sum(w*w) for the resistance and inductance of each row."""
    c = F.col
    num = (r * c("dv_is") + l_h * c("dv_isd") + r * r * c("ir_is") + r * l_h * (c("ir_isd") + c("ird_is"))
           + l_h * l_h * c("ird_isd"))
    den = r * r * c("bb") + r * l_h * c("bd") * 2.0 + l_h * l_h * c("dd")
    return sums.withColumns({"uw": num, "ww": den}).withColumn("td_est", ratio(c("uw"), c("ww")))


def td_estimate(samples: DataFrame, params: DataFrame, keys: list[str], cfg: SignalConfig,
                deriv: str = "quadratic") -> DataFrame:
    """Time-domain location per window: sum(u*w) / sum(w*w) over both modes."""
    win = td_sums(samples, keys, cfg, deriv).join(params, keys)
    return td_project(win, F.col("z1r"), F.col("z1x") / cfg.omega).select(*keys, "win_end", "uw", "ww", "td_est")


def td_scale_sweep(samples: DataFrame, params: DataFrame, keys: list[str], cfg: SignalConfig,
                   scales: list[tuple[str, float, float]], deriv: str = "quadratic") -> DataFrame:
    """Estimates under scaled R and L from one pass over the samples."""
    win = signal.with_scales(td_sums(samples, keys, cfg, deriv).join(params, keys), scales)
    c = F.col
    return td_project(win, c("z1r") * c("scale_r"), c("z1x") / cfg.omega * c("scale_l")).select(*keys, "win_end", "scale", "td_est")


def window_phasors(samples: DataFrame, keys: list[str], cols: list[str], cfg: SignalConfig,
                   which: tuple[str, ...] = ("last",)) -> DataFrame:
    """Phasors of the last (``l_``) and first (``f_``) cycle of every window."""
    part = keys
    aggs = windows.dft_sums(cols, cfg)
    panes = windows.pane_table(windows.with_dft_terms(samples, cfg), part, aggs, cfg)
    specs = {}
    for w in which:
        specs |= windows.cycle_specs(cols, cfg, f"{w[0]}_", w)
    return windows.roll_panes(panes, part, specs, cfg)


def end_sums(cols: list[str], cfg: SignalConfig, term: str = "term") -> dict[str, Column]:
    """Phasor sums of both ends in one aggregate: ``s_`` and ``r_`` columns, and the remote end's samples."""
    g = 2.0 / cfg.cycle
    out = {"_remote": F.expr(f"count_if({term} = 1)")}
    for t, tag in ((0, "s"), (1, "r")):
        for c in cols:
            out[f"{tag}_{c}_c"] = F.expr(f"sum(CASE WHEN {term} = {t} THEN {c} * _cos END) * {g!r}D")
            out[f"{tag}_{c}_s"] = F.expr(f"sum(CASE WHEN {term} = {t} THEN {c} * _sin END) * {-g!r}D")
    return out


def both_phasors(samples: DataFrame, keys: list[str], cols: list[str], cfg: SignalConfig, term: str = "term") -> DataFrame:
    """Last-cycle phasors of both ends per window: ``s_l_`` and ``r_l_`` columns.

    The local end must have the whole window; without the whole remote window
    the ``r_`` columns are NULL.
    """
    local = F.when(F.col(term) == 0, F.lit(1))
    panes = windows.pane_table(windows.with_dft_terms(samples, cfg), keys, end_sums(cols, cfg, term), cfg, require=local)
    lo = -(cfg.cycle_panes - 1)
    specs = {"_remote": ("sum", "_remote", -(cfg.win_panes - 1), 0)}
    for tag in "sr":
        for c in cols:
            specs[f"{tag}_l_{c}_re"] = ("sum", f"{tag}_{c}_c", lo, 0)
            specs[f"{tag}_l_{c}_im"] = ("sum", f"{tag}_{c}_s", lo, 0)
    rolled = windows.roll_panes(panes, keys, specs, cfg)
    whole = F.col("_remote") == cfg.win
    return rolled.select(*keys, "win_end", *[F.when(whole, F.col(k)).alias(k) if k.startswith("r_") else k for k in specs if k != "_remote"])


def both_cycles(samples: DataFrame, starts: DataFrame, keys: list[str], cols: list[str], cfg: SignalConfig,
                prefix: str, term: str = "term") -> DataFrame:
    """Phasors of both ends over the cycle from ``pre`` on: (keys, pre, ``s_`` and ``r_`` columns).

    An end without the whole cycle has NULLs.
    """
    want = starts.select(*keys, "pre").distinct().select("*", F.explode(F.sequence(
        F.floor(F.col("pre") / cfg.cycle), F.floor((F.col("pre") + cfg.cycle - 1) / cfg.cycle))).alias("_slot"))
    hit = (samples.withColumn("_slot", F.floor(F.col("n") / cfg.cycle)).join(want, [*keys, "_slot"])
           .where((F.col("n") >= F.col("pre")) & (F.col("n") < F.col("pre") + cfg.cycle)))
    sums = windows.with_dft_terms(hit, cfg).groupBy(*keys, "pre").agg(
        *[a.alias(k) for k, a in end_sums(cols, cfg, term).items()], F.count(F.lit(1)).alias("_all"))
    out = []
    for tag, have in (("s", F.col("_all") - F.col("_remote")), ("r", F.col("_remote"))):
        for c in cols:
            out += [F.when(have == cfg.cycle, F.col(f"{tag}_{c}_{a}")).alias(f"{tag}_{prefix}{c}_{b}") for a, b in (("c", "re"), ("s", "im"))]
    return sums.select(*keys, "pre", *out)


def fault_cycles(samples: DataFrame, episodes: DataFrame, keys: list[str], cols: list[str], cfg: SignalConfig,
                 starts: dict[str, int], term: str = "term") -> DataFrame:
    """Phasors of both ends over named cycles of each episode, in one aggregate: (keys, nf, ``s_p_ia_re`` ...).

    ``starts`` maps a name to the cycle's first sample after inception. Every
    episode has its row; a cycle that is not whole at an end is NULL there.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("_st"), (F.col("nf") + v).alias("pre")) for k, v in starts.items()])
    want = episodes.select(*keys, "nf").distinct().select(*keys, "nf", F.inline(cells)).select("*", F.explode(F.sequence(
        F.floor(F.col("pre") / cfg.cycle), F.floor((F.col("pre") + cfg.cycle - 1) / cfg.cycle))).alias("_slot"))
    hit = (samples.withColumn("_slot", F.floor(F.col("n") / cfg.cycle)).join(want, [*keys, "_slot"])
           .where((F.col("n") >= F.col("pre")) & (F.col("n") < F.col("pre") + cfg.cycle)))
    g, aggs = 2.0 / cfg.cycle, []
    for t, tag in ((0, "s"), (1, "r")):
        for st in starts:
            at = f"{term} = {t} AND _st = '{st}'"
            whole = f"CASE WHEN count_if({at}) = {cfg.cycle} THEN"
            for c in cols:
                aggs.append(F.expr(f"{whole} sum(CASE WHEN {at} THEN {c} * _cos END) * {g!r}D END").alias(f"{tag}_{st}_{c}_re"))
                aggs.append(F.expr(f"{whole} sum(CASE WHEN {at} THEN {c} * _sin END) * {-g!r}D END").alias(f"{tag}_{st}_{c}_im"))
    found = windows.with_dft_terms(hit, cfg).groupBy(*keys, "nf").agg(*aggs)
    return episodes.select(*keys, "nf").distinct().join(found, [*keys, "nf"], "left")


def seq1(prefix: str, kind: str) -> Cx:
    """Positive sequence of the three currents (kind 'i') or voltages ('v')."""
    return pos_seq(*[cx(f"{prefix}{kind}{p}") for p in "abc"])


def phasor_ratio(vs: Cx, is_: Cx, vr: Cx, ir: Cx, z: Cx) -> tuple[Cx, Cx]:
    """Numerator and denominator of (VS - VR + Z IR) / (Z (IS + IR))."""
    return vs - vr + z * ir, z * (is_ + ir)


def phasor_estimate(samples: DataFrame, params: DataFrame, keys: list[str], cfg: SignalConfig) -> DataFrame:
    """Nameplate-Z phasor location on the last cycle; NULL if |den| <= 1e-9."""
    df = both_phasors(samples, keys, signal.CHANNELS, cfg).where(F.col("r_l_ia_re").isNotNull()).join(params, keys)
    z = lines.z1()
    num, den = phasor_ratio(seq1("s_l_", "v"), seq1("s_l_", "i"), seq1("r_l_", "v"), seq1("r_l_", "i"), z)
    df = df.withColumns({"_nr": num.re, "_ni": num.im, "_dr": den.re, "_di": den.im})
    n, d = Cx("_nr", "_ni"), Cx("_dr", "_di")
    return df.select(*keys, "win_end", F.when(d.abs() > 1e-9, (n / d).re).alias("ph_est"))


def episode_locator(samples: DataFrame, episodes: DataFrame, keys: list[str], cfg: SignalConfig,
                    skip_cycles: float = 1.0) -> DataFrame:
    """Per-episode phasor location with the impedance seen before the fault.

    ``episodes`` holds ``nf``. The pre-fault cycle starts two cycles before
    inception, the fault cycle ``skip_cycles`` after it.
    """
    cols = signal.CHANNELS
    df = fault_cycles(samples, episodes, keys, cols, cfg, {"p": -2 * cfg.cycle, "f": int(round(skip_cycles * cfg.cycle))})
    q = {}
    for t in "sr":
        for st in "pf":
            q[f"v{t}{st}"] = seq1(f"{t}_{st}_", "v")
            q[f"i{t}{st}"] = seq1(f"{t}_{st}_", "i")
    df = df.select(*keys, "nf", *[col.alias(k) for k, col in
                            {f"{a}_{b}": v for a, z in q.items() for b, v in (("re", z.re), ("im", z.im))}.items()])
    z = (cx("vsp") - cx("vrp")) / ((cx("isp") - cx("irp")) * 0.5)
    df = df.withColumns({"z_re": z.re, "z_im": z.im})
    num, den = phasor_ratio(cx("vsf"), cx("isf"), cx("vrf"), cx("irf"), cx("z"))
    df = df.withColumns({"_n_re": num.re, "_n_im": num.im, "_d_re": den.re, "_d_im": den.im})
    d = cx("_n") / cx("_d")
    out = df.select(
        *keys, "nf", "z_re", "z_im", d.re.alias("d"), d.im.alias("d_im"),
        (F.try_divide((cx("isp") + cx("irp")).abs(), cx("isp").abs() + 1e-9)).alias("preload_ratio"),
        cx("isp").abs().alias("i_pre"), cx("isf").abs().alias("i_post"))
    # Grouped once more on the keys it is grouped by, at no shuffle: a filter on these long expressions would
    # otherwise be pushed through all of them, and planning would take minutes.
    return out.groupBy(*keys, "nf").agg(*[F.first(k).alias(k) for k in out.columns if k not in (*keys, "nf")]).drop("nf")
