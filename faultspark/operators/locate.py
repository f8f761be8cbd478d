"""One-ended and staged location estimates, source and line impedances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.config import SignalConfig
from faultspark.functions.cplx import Cx, cx, pos_seq, put, zero_seq
from faultspark.functions.scalar import clip, defined, is_transient
from faultspark.functions.cplx import neg_seq, wrap_angle
from faultspark.operators import lines, signal, two_ended, windows
from faultspark.operators.blocks import halo_blocks, owned_samples, touched_samples
from faultspark.operators.features import CURRENT_FLOOR, DENOMINATOR_FLOOR, GROUND, LOOPS, ROTATION
from faultspark.operators.moments import range_sums
from faultspark.operators.numbering import column_quantiles, first_k, quantiles

METHODS = ["R", "T", "T2", "MT", "E"]


def choose(loop: str, values: dict[str, Cx]) -> Cx:
    """Complex value of the row's loop, named by column ``loop``."""
    case = lambda get: f"CASE {loop} " + " ".join(f"WHEN '{lp}' THEN {get(v)}" for lp, v in values.items()) + " END"
    return Cx(case(lambda v: v.x), case(lambda v: v.y))


def loop_quantity(loop: str, ph: dict[str, Cx], extra: Cx | None) -> Cx:
    """Phase value plus a ground term, or the difference of two phases."""
    out = {}
    for lp in LOOPS:
        if lp in GROUND:
            v = ph[lp[0]]
            out[lp] = v if extra is None else v + extra
        else:
            out[lp] = ph[lp[0]] - ph[lp[1]]
    return choose(loop, out)


def takagi(v: Cx, i: Cx, z: Cx, pol: Cx) -> Column:
    """Im(V P*) / Im(Z I P*), undefined when the divisor vanishes."""
    den = (z * i * pol.conj()).im
    return F.when(F.abs(den) > DENOMINATOR_FLOOR, F.try_divide((v * pol.conj()).im, den))


def safe_ratio(num: Cx, den: Cx, floor: float = CURRENT_FLOOR) -> Cx:
    ok = den.abs() > floor
    z = num / den
    return Cx(F.when(ok, z.re), F.when(ok, z.im))


def window_context(samples: DataFrame, wins: DataFrame, params: DataFrame, keys: list[str],
                   cfg: SignalConfig) -> DataFrame:
    """Last-cycle and pre-fault phasors of both ends for the wanted windows.

    ``wins`` has (keys, win_end, nf, ...). Columns of what is missing are NULL:
    the remote end, or the pre-fault cycle of an early fault. Each set of
    phasors takes one grouped pass over the samples of both ends.
    """
    ph = two_ended.both_phasors(touched_samples(samples, wins, keys, cfg), keys, signal.CHANNELS, cfg)
    starts = wins.select(*keys, (F.col("nf") - cfg.memory_gap - cfg.cycle).alias("pre")).distinct()
    pre = two_ended.both_cycles(samples, starts, keys, signal.CHANNELS, cfg, "p_")
    df = wins.join(ph, [*keys, "win_end"]).withColumn("pre", F.col("nf") - cfg.memory_gap - cfg.cycle)
    return df.join(pre, [*keys, "pre"], "left").drop("pre").join(params, keys)


def loop_context(df: DataFrame) -> DataFrame:
    """Loop V, I, dI, sequence and superimposed sequence quantities."""
    z1, z0 = lines.z1(), lines.z0()
    i = {p: cx(f"s_l_i{p}") for p in "abc"}
    v = {p: cx(f"s_l_v{p}") for p in "abc"}
    diff = {f"{t}{q}": [cx(f"{t}_l_{q}{p}") - cx(f"{t}_p_{q}{p}") for p in "abc"] for t in "sr" for q in "iv"}
    first = {"k0": (z0 - z1) / (z1 * 3.0), "I0": zero_seq(*i.values()), "I2": neg_seq(*i.values())}
    for t in "sr":
        for q, name in (("i", "I"), ("v", "V")):
            first[f"{t}0{name}"] = zero_seq(*diff[t + q])
            first[f"{t}1{name}"] = pos_seq(*diff[t + q])
    for p, d in zip("abc", diff["si"]):
        first[f"ds_i{p}"] = d
    spent = [f"{t}_{st}_{q}{p}_{x}" for t in "sr" for st in "lp" for q in "iv" for p in "abc" for x in ("re", "im")
             if (st, q) == ("p", "i") or q == "v" and (t, st) != ("s", "l")]
    df = put(df, first).drop(*spent)
    df = put(df, {"_gi": cx("k0") * cx("I0") * 3.0, "_gd": cx("k0") * cx("s0I") * 3.0})
    loop = "loop"
    return put(df, {
        "V": loop_quantity(loop, v, None),
        "I": loop_quantity(loop, i, cx("_gi")),
        "D": loop_quantity(loop, {p: cx(f"ds_i{p}") for p in "abc"}, cx("_gd")),
        "P2": choose(loop, {lp: cx("I2") * (1.0 / complex(ROTATION[lp])) for lp in LOOPS}),
    })


def source_impedances(df: DataFrame) -> DataFrame:
    """Positive and zero sequence source impedances behind both ends."""
    out = {}
    for name, t, s in (("ZSA", "s", 1), ("ZSB", "r", 1), ("Z0SA", "s", 0), ("Z0SB", "r", 0)):
        out[name] = safe_ratio(-cx(f"{t}{s}V"), cx(f"{t}{s}I"))
    return put(df, out)


def eriksson(df: DataFrame, out: str = "E") -> DataFrame:
    """Root of d*d - p*d + q nearest mid-line, if one lies in [-0.1, 1.1].

    No fallback: a flat divisor, a negative discriminant or no root in range
    leaves the estimate undefined.
    """
    z, i = lines.z1(), cx("I")
    df = put(df, {"_q": cx("V") / (z * i), "_b": cx("ZSB") / z})
    df = put(df, {"_k1": cx("_b") + cx("_q") + 1.0, "_k2": cx("_q") * (cx("_b") + 1.0),
                  "_k3": cx("D") / (z * i) * ((cx("ZSA") + cx("ZSB")) / z + 1.0)})
    c = F.col
    turn = F.try_divide(c("_k3_re"), c("_k3_im"))
    df = df.withColumn("_t", F.when(F.abs(c("_k3_im")) >= DENOMINATOR_FLOOR, turn))
    df = df.withColumns({"_p": c("_k1_re") - c("_t") * c("_k1_im"), "_qq": c("_k2_re") - c("_t") * c("_k2_im")})
    df = df.withColumn("_disc", c("_p") * c("_p") - c("_qq") * 4.0)
    root = F.when(c("_disc") >= 0, F.sqrt("_disc"))
    df = df.withColumn("_root", root)
    cells = []
    for rank, x in enumerate(((c("_p") - c("_root")) / 2.0, (c("_p") + c("_root")) / 2.0)):
        cells.append(F.when((x >= -0.1) & (x <= 1.1),
                            F.struct(F.abs(x - 0.5).alias("gap"), F.lit(rank).alias("rank"), x.alias("x"))))
    best = F.array_min(F.array(*cells))["x"]
    return df.withColumn(out, best).drop("_t", "_p", "_qq", "_disc", "_root")


def modified_takagi(df: DataFrame, out: str = "MT", rounds: int = 3) -> DataFrame:
    """Zero-sequence polarised estimate with the angle corrected for d."""
    z0 = lines.z0()
    d = "0.5D"
    for k in range(rounds):
        ratio = (cx("Z0SB") + z0 * F.expr(f"1 - {d}")) / (cx("Z0SA") + z0 + cx("Z0SB"))
        df = put(df, {f"_w{k}": ratio})
        pol = (cx("I0") * 3.0).turn(cx(f"_w{k}").arg())
        df = put(df, {f"_pol{k}": pol})
        df = df.withColumn(f"_t{k}", takagi(cx("V"), cx("I"), lines.z1(), cx(f"_pol{k}")))
        df = df.withColumn(f"_d{k}", F.coalesce(clip(F.col(f"_t{k}"), -1, 2), F.lit(0.5)))
        d = f"_d{k}"
    known = F.col("Z0SA_re").isNotNull() & F.col("Z0SB_re").isNotNull()
    ground = F.col("loop").isin(GROUND)
    return df.withColumn(out, F.when(~ground, F.col("T")).when(known, F.col(d)))


def classical_estimates(samples: DataFrame, wins: DataFrame, params: DataFrame, keys: list[str],
                        cfg: SignalConfig) -> DataFrame:
    """R, T, T2, MT and E per wanted window, clipped; undefined stays NULL.

    ``wins`` holds (keys, win_end, nf, loop, three_ph, ...).
    """
    df = loop_context(window_context(samples, wins, params, keys, cfg))
    z = lines.z1()
    live = cx("I").abs() > CURRENT_FLOOR
    df = df.withColumns({
        "R": F.when(live, (cx("V") / cx("I")).im / F.col("z1x")),
        "T": takagi(cx("V"), cx("I"), z, cx("D")),
        "T2": takagi(cx("V"), cx("I"), z, cx("P2")),
    })
    df = df.withColumn("T2", F.when(F.col("three_ph"), F.col("R")).otherwise(F.col("T2")))
    df = modified_takagi(eriksson(source_impedances(df)))
    df = df.withColumns({m: defined(F.col(m)) for m in METHODS})
    return df.select(*wins.columns, *[clip(F.col(m), -1, 2).alias(m) for m in METHODS])


def conditioning(samples: DataFrame, wins: DataFrame, params: DataFrame, keys: list[str],
                 cfg: SignalConfig, min_post_ms: float = 25.0, eps: float = 0.05) -> DataFrame:
    """Observed and predicted one-ended error, amplification and angle error.

    Single-phase short circuits with both ends measured, late windows only.
    ``wins`` holds (keys, win_end, nf, post_ms, etype, loop, r_f, y).
    """
    wins = wins.where((F.col("etype") == "flt_1phg_shc") & (F.col("post_ms") >= min_post_ms))
    df = loop_context(window_context(samples, wins, params, keys, cfg))
    phase = lambda t: choose("loop", {f"{p}g": cx(f"{t}_l_i{p}") for p in "abc"})
    df = put(df, {"IF": phase("s") + phase("r")}).where(F.col("IF_re").isNotNull())
    df = put(df, {"_f": cx("IF") / cx("I"), "_z": cx("V") / cx("I"), "_m": cx("D") / cx("I")})
    z = lines.z1()
    df = df.withColumns({"absZ": z.abs(), "_th": z.arg(), "ratio_IF_I": cx("_f").abs(), "_b": cx("_f").arg(),
                         "_bh_T": cx("_m").arg(), "_bh_R": F.lit(0.0)})
    c = F.col
    df = df.withColumn("rho", c("r_f") / c("absZ"))
    out = {"beta_deg": F.degrees("_b")}
    for m in ("R", "T"):
        bh = c(f"_bh_{m}")
        s = F.sin(c("_th") - bh)
        out[f"e_obs_{m}"] = F.try_divide(cx("_z").turn(bh).im, z.turn(bh).im) - c("y")
        out[f"e_pred_{m}"] = F.try_divide(c("rho") * c("ratio_IF_I") * F.sin(c("_b") - bh), s)
        out[f"kappa_{m}"] = F.try_divide(c("ratio_IF_I"), s)
        out[f"angerr_{m}_deg"] = F.degrees(wrap_angle(c("_b") - bh))
    df = df.withColumns(out)
    need = F.lit(eps) / F.greatest(c("rho") * F.abs(c("kappa_T")), F.lit(1e-12))
    return (df.withColumn("Dreq_deg", F.degrees(F.asin(F.least(F.lit(1.0), need))))
            .select(*wins.columns, "absZ", "rho", "ratio_IF_I", *out, "Dreq_deg"))


# --- staged two-ended locator ----------------------------------------------------

PARTS = [f"{q}_{m}" for q in ("vs", "is", "vr", "ir") for m in signal.MODES]


def ls_terms(cols: list[str]) -> tuple[dict[str, Column], dict[str, str], dict[str, str]]:
    """What ``range_sums`` must sum for least squares: sums, their names weighted by t, and by t * t."""
    names = ["_c", "_s", *cols]
    sums = {"_n": F.lit(1.0), **{f"{u}_1": F.col(u) for u in names}}
    for u in names:
        for b in ("_c", "_s"):
            if (u, b) != ("_s", "_c"):
                sums[f"{u}{b}"] = F.col(u) * F.col(b)
    return sums, {"_n": "_t", **{f"{u}_1": f"{u}_t" for u in names}}, {"_n": "_tt"}


def ls_phasors(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with least-squares phasors a - jb of x ~ a cos + b sin + c + e t from the sums of ``ls_terms``, as x_lre and x_lim.

    Offset and drift are projected out of the sums, which leaves a 2x2 system
    per signal. Fewer than four samples or a singular system give NULL.
    """
    n, t = F.col("_n"), F.col("_t")
    names = ["_c", "_s", *cols]
    df = df.withColumns({"_spread": F.col("_tt") - t * t / n, **{f"{u}_cov": F.col(f"{u}_t") - F.col(f"{u}_1") * t / n for u in names}})

    def inner(u, v):
        return (F.col(f"{u}{v}") - F.col(f"{u}_1") * F.col(f"{v}_1") / n
                - F.try_divide(F.col(f"{u}_cov") * F.col(f"{v}_cov"), F.col("_spread")))

    df = df.withColumns({"_cc": inner("_c", "_c"), "_cs": inner("_c", "_s"), "_ss": inner("_s", "_s"),
                         **{f"{x}{b}_res": inner(x, b) for x in cols for b in ("_c", "_s")}})
    cc, cs, ss = (F.col(k) for k in ("_cc", "_cs", "_ss"))
    df = df.withColumn("_det", F.when((n >= 4) & (cc * ss - cs * cs > 1e-12), cc * ss - cs * cs))
    out = {}
    for x in cols:
        xc, xs = F.col(f"{x}_c_res"), F.col(f"{x}_s_res")
        out[f"{x}_lre"] = (xc * ss - xs * cs) / F.col("_det")
        out[f"{x}_lim"] = -(xs * cc - xc * cs) / F.col("_det")
    return df.withColumns(out)


def staged_locator(samples: DataFrame, wins: DataFrame, params: DataFrame, keys: list[str], cfg: SignalConfig,
                   full_ms: float = 21.0, ls_ms: float = 3.0, skip_s: float = 0.001) -> DataFrame:
    """Location by the data available after inception.

    From ``full_ms``: last-cycle phasors; from ``ls_ms``: least-squares phasors
    of the post-fault samples; earlier: mid-line. Positive sequence is
    (alpha + j beta) / 2 of the modal phasors. Both kinds are sums between two
    positions: no sample is copied per window.
    """
    pairs = signal.pair_terminals(halo_blocks(samples, cfg), keys, signal.CHANNELS)
    modal = owned_samples(signal.modal_inputs(pairs), cfg).drop("blk")
    late = F.col("tau_ms") >= full_ms
    skip = int(round(skip_s * cfg.fs))
    first = F.when(late, F.col("win_end") - cfg.cycle).otherwise(F.greatest(F.col("nf") + skip, F.col("win_end") - cfg.win))
    ranges = wins.where(F.col("tau_ms") >= ls_ms).select(
        *keys, "win_end", late.alias("_late"), F.greatest(first, F.lit(0)).alias("_first")).distinct()
    sums, timed, squared = ls_terms(PARTS)
    ph = range_sums(windows.with_dft_terms(modal, cfg).withColumnsRenamed({"_cos": "_c", "_sin": "_s"}), ranges, keys, sums,
                    cfg.block, "_first", "win_end", timed, squared, cfg.cycle)
    group, g = [*keys, "win_end"], 2.0 / cfg.cycle
    last = {f"{x}_{p}": F.col(f"{x}{b}") * k for x in PARTS for p, b, k in (("re", "_c", g), ("im", "_s", -g))}
    ph = ls_phasors(ph, PARTS).select(*group, *[F.when(F.col("_late"), v).otherwise(F.col(f"{k[:-3]}_l{k[-2:]}")).alias(k) for k, v in last.items()])
    j = 1j
    pos = {q: (cx(f"{q}_al") + cx(f"{q}_be") * j) * 0.5 for q in ("vs", "is", "vr", "ir")}
    df = ph.join(params, keys)
    num, den = two_ended.phasor_ratio(pos["vs"], pos["is"], pos["vr"], pos["ir"], lines.z1())
    df = put(df, {"_n": num, "_d": den}).select(*group, (cx("_n") / cx("_d")).re.alias("_est"))
    out = wins.join(df, group, "left")
    return out.withColumn("est", F.when(F.col("tau_ms") < ls_ms, 0.5).otherwise(F.col("_est"))).drop("_est")


def phasor_or_td(tau_ms: Column, phasor: Column, td: Column, full_ms: float = 21.0) -> Column:
    return F.when(tau_ms >= full_ms, phasor).otherwise(td)


# --- line impedance from normal operation -------------------------------------------

def identify_impedance(per_episode: DataFrame, nameplate: DataFrame, line: list[str], order: list,
                       per_line: int = 10) -> DataFrame:
    """Median impedance of the first episodes per line, else nameplate.

    Z0 keeps its reactance; its resistance scales with the identified R1.
    The median is over at most ``per_line`` rows.
    """
    few = first_k(per_episode.where(F.col("z_re").isNotNull()), line, order, per_line)
    ident = few.groupBy(*line).agg(F.percentile("z_re", 0.5).alias("_re"), F.percentile("z_im", 0.5).alias("_im"),
                                   F.count(F.lit(1)).alias("n_ident"))
    c = F.col
    return nameplate.join(ident, line, "left").select(
        *line, "length_km", F.coalesce("_re", "z1r").alias("z1r"), F.coalesce("_im", "z1x").alias("z1x"),
        F.coalesce(F.try_divide(c("z0r") * c("_re"), c("z1r")), c("z0r")).alias("z0r"), "z0x",
        F.coalesce("n_ident", F.lit(0)).alias("n_ident"))


def median_impedance(per_episode: DataFrame, line: list[str]) -> DataFrame:
    """Median over all episodes of a line, real and imaginary part."""
    return column_quantiles(per_episode, line, {"z_re": {"z_re": 0.5}, "z_im": {"z_im": 0.5}})


def compare_impedance(identified: DataFrame, nameplate: DataFrame, line: list[str]) -> DataFrame:
    """Magnitude ratio and angles of identified against nameplate values."""
    c = F.col
    df = identified.join(nameplate, line)
    zi, zn = cx("z"), lines.z1()
    return df.select(*line, (zi.abs() / zn.abs()).alias("ratio_abs"), F.degrees(zn.arg()).alias("ang_np"),
                     F.degrees(zi.arg()).alias("ang_id"), (c("z_re") / c("z1r")).alias("ratio_r"),
                     (c("z_im") / c("z1x")).alias("ratio_x"))


def impedance_deviation(compared: DataFrame, limit: float = 0.05) -> DataFrame:
    """Count above the limit, median and maximum of |ratio - 1|."""
    dev = compared.select(F.abs(F.col("ratio_abs") - 1.0).alias("dev"))
    head = dev.agg(F.count(F.lit(1)).alias("lines"), F.sum((F.col("dev") > limit).cast("int")).alias("n_above"),
                   F.max("dev").alias("max_dev"))
    med = quantiles(dev, [], "dev", {"median_dev": 0.5})
    return head.withColumn("median_dev", med.scalar())


# --- choices between estimates -------------------------------------------------------

def switch_rule(post_ms: Column, learned: Column, classical: Column, from_ms: float = 20.0) -> Column:
    """Learned value early, classical value later where it is defined."""
    return F.when((post_ms >= from_ms - 1e-6) & classical.isNotNull(), classical).otherwise(learned)


def orientation_check(df: DataFrame, by: list[str], est: str, y: str) -> DataFrame:
    """Mean error against the label and against the reversed label."""
    v = clip(F.coalesce(F.col(est), F.lit(0.5)), 0, 1)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               (F.avg(F.abs(v - F.col(y))) * 100).alias("mae"),
                               (F.avg(F.abs(v - (1 - F.col(y)))) * 100).alias("mae_reversed"))


def bolted(max_ohm: float = 1.0) -> Column:
    """Near-zero fault resistance, no transient type, late window."""
    return (F.col("r_f") <= max_ohm) & ~is_transient(F.col("etype")) & (F.col("post_ms") >= 25)
