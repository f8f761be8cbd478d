"""The 77 window features of one terminal.

Each feature is a projection of window sums: phasors of the first and last
cycle, and the normal-equation sums of the time-domain loop fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.config import SignalConfig
from faultspark.functions.cplx import ALPHA, Cx, cx, neg_seq, pos_seq, put, zero_seq
from faultspark.functions.scalar import clip
from faultspark.operators import lines, signal, windows
from faultspark.operators.blocks import block_params, halo_blocks, wanted_blocks

# --- fixed values of the feature definition ---------------------------------
LOOPS = ["ag", "bg", "cg", "ab", "bc", "ca"]
A2 = ALPHA.conjugate()
ROTATION = {"ag": 1.0, "bg": A2, "cg": ALPHA, "ab": 1 - A2, "bc": A2 - ALPHA, "ca": ALPHA - 1}
ZERO_SEQ_FLOOR = 1e-6
CURRENT_FLOOR = 1e-9
DENOMINATOR_FLOOR = 1e-12
FORBIDDEN = ["sim_idx", "line", "etype", "tau", "R", "y", "oracle", "phys_", "theta", "sin_t", "cos_t", "teacher"]
PHASOR_FEATURES = [
    "ag_zr", "ag_zi", "ag_react", "ag_tak2", "ag_takd", "ag_tak0", "ag_absz",
    "bg_zr", "bg_zi", "bg_react", "bg_tak2", "bg_takd", "bg_tak0", "bg_absz",
    "cg_zr", "cg_zi", "cg_react", "cg_tak2", "cg_takd", "cg_tak0", "cg_absz",
    "ab_zr", "ab_zi", "ab_react", "ab_tak2", "ab_takd", "ab_absz",
    "bc_zr", "bc_zi", "bc_react", "bc_tak2", "bc_takd", "bc_absz",
    "ca_zr", "ca_zi", "ca_react", "ca_tak2", "ca_takd", "ca_absz",
    "i0r", "i2r", "v0r", "v2r", "i2c", "i2s", "i0c", "i0s",
    "ia_onset", "va_drop", "ia_share", "dia_rel",
    "ib_onset", "vb_drop", "ib_share", "dib_rel",
    "ic_onset", "vc_drop", "ic_share", "dic_rel",
]
TD_FEATURES = [
    "ag_dtd", "ag_drl", "ag_tdres",
    "bg_dtd", "bg_drl", "bg_tdres",
    "cg_dtd", "cg_drl", "cg_tdres",
    "ab_dtd", "ab_drl", "ab_tdres",
    "bc_dtd", "bc_drl", "bc_tdres",
    "ca_dtd", "ca_drl", "ca_tdres",
]
# -----------------------------------------------------------------------------

GROUND = ["ag", "bg", "cg"]
FEATURES = PHASOR_FEATURES + TD_FEATURES
FEATURE_GROUPS = {"phasor": PHASOR_FEATURES, "td": TD_FEATURES, "all": FEATURES}


def check_allow(allow: list[str]) -> None:
    """Reject feature lists that repeat a name or could leak the answer."""
    if len(set(allow)) != len(allow):
        raise ValueError("feature names repeat")
    bad = [a for a in allow if a.startswith(tuple(FORBIDDEN))]
    if bad:
        raise ValueError(f"forbidden features: {sorted(set(bad))}")


def select_features(df: DataFrame, keys: list[str], allow: list[str]) -> DataFrame:
    check_allow(allow)
    missing = sorted(set(allow) - set(df.columns))
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*keys, *allow)


def td_loop_signals(df: DataFrame, cfg: SignalConfig) -> DataFrame:
    """Per loop: voltage v, R-L response u, current change g (sample level)."""
    w = repr(cfg.omega) + "D"
    df = df.withColumns({k: F.expr(v) for k, v in {
        "_i0": "(ia + ib + ic) / 3.0D", "_i0d": "(ia_d + ib_d + ic_d) / 3.0D", "_l1": f"z1x / {w}",
        "_dr": "z0r - z1r", "_dl": f"z0x / {w} - z1x / {w}"}.items()})
    out = {}
    for lp in LOOPS:
        if lp in GROUND:
            p = lp[0]
            out[f"v_{lp}"] = f"v{p}"
            out[f"u_{lp}"] = f"z1r * i{p} + _l1 * i{p}_d + _dr * _i0 + _dl * _i0d"
            out[f"g_{lp}"] = f"i{p}_g"
        else:
            p, q = lp
            out[f"v_{lp}"] = f"v{p} - v{q}"
            out[f"u_{lp}"] = f"z1r * (i{p} - i{q}) + _l1 * (i{p}_d - i{q}_d)"
            out[f"g_{lp}"] = f"i{p}_g - i{q}_g"
    return df.withColumns({k: F.expr(v) for k, v in out.items()})


FIT_SUMS = ("vv", "uu", "gg", "vu", "vg", "ug")


def window_sums(samples: DataFrame, params: DataFrame, keys: list[str], cfg: SignalConfig,
                phasors: bool = True, td: bool = True, deriv: str = "quadratic",
                wanted: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """All window sums behind the features, after one shuffle of the samples.

    ``labels`` (keys, win_end, more columns) are joined to the windows (inner). They travel by block, so the wide sums stay where
    they are; a block has ``block_hops`` windows at most.

    With ``wanted`` (keys, win_end) only blocks owning such a window are read
    into the shuffle, and only those windows are returned.

    Phasors of all windows need no samples around a pane, so samples are summed
    by pane before anything is copied; only panes go to two runs of windows.
    """
    blocked = td or wanted is not None or labels is not None
    part = [*keys, "blk"] if blocked else keys
    df = halo_blocks(samples, cfg) if blocked else samples
    if wanted is not None:
        df = wanted_blocks(df, wanted, keys, cfg)
    aggs, specs = {}, {}
    require = None
    if td:
        df = signal.DERIVATIVES[deriv](df, signal.CURRENTS, part, cfg)
        df = signal.delta_cycle(df, signal.CURRENTS, part, cfg)
        own = labels if labels is not None else wanted
        df = lines.attach(df, params, keys) if own is None else df.join(block_params(own, params, keys, cfg), part)
        df = td_loop_signals(df, cfg)
        span = (cfg.win - cfg.cycle) // cfg.hop
        for lp in LOOPS:
            for s in FIT_SUMS:
                aggs[f"{s}_{lp}"] = F.expr(f"sum({s[0]}_{lp} * {s[1]}_{lp})")
                specs[f"{s}_{lp}"] = ("sum", f"{s}_{lp}", -(span - 1), 0)
        require = F.col("u_ag")
    if phasors:
        df = windows.with_dft_terms(df, cfg)
        aggs |= windows.dft_sums(signal.CHANNELS, cfg)
        specs |= windows.cycle_specs(signal.CHANNELS, cfg, "l_", "last")
        specs |= windows.cycle_specs(signal.CHANNELS, cfg, "f_", "first")
    panes = windows.pane_table(df, part, aggs, cfg, require=require)
    rolled = windows.roll_panes(panes, part, specs, cfg, blk="blk" if blocked else None, keep_blk=labels is not None)
    if labels is not None:
        rest = [c for c in labels.columns if c not in keys]
        own = labels.select(*keys, F.floor((F.col("win_end") - 1) / cfg.block).alias("blk"), F.struct(*rest).alias("_l"))
        own = own.groupBy(*part).agg(F.collect_list("_l").alias("_l"))
        mine = F.filter("_l", lambda x: x["win_end"] == F.col("win_end"))
        rolled = rolled.join(own, part).withColumn("_l", F.explode(mine))
        rolled = rolled.withColumns({c: F.col(f"_l.{c}") for c in rest if c != "win_end"}).drop("_l", "blk")
    if wanted is not None:
        rolled = rolled.join(wanted.select(*keys, "win_end"), [*keys, "win_end"], "left_semi")
    return rolled.join(params, keys)


def loop_phasors(df: DataFrame) -> DataFrame:
    """Sequence components, superimposed currents and loop quantities."""
    i = [cx(f"l_i{p}") for p in "abc"]
    v = [cx(f"l_v{p}") for p in "abc"]
    z1, z0 = lines.z1(), lines.z0()
    df = put(df, {
        "_i0": zero_seq(*i), "_i1": pos_seq(*i), "_i2": neg_seq(*i),
        "_v0": zero_seq(*v), "_v1": pos_seq(*v), "_v2": neg_seq(*v),
        **{f"_d{p}": cx(f"l_i{p}") - cx(f"f_i{p}") for p in "abc"},
        "_k0": (z0 - z1) / (z1 * 3.0),
    })
    df = put(df, {"_kd": cx("_k0") * (cx("_da") + cx("_db") + cx("_dc")), "_ki": cx("_k0") * cx("_i0") * 3.0})
    out = {}
    for lp in LOOPS:
        if lp in GROUND:
            p = lp[0]
            out[f"_V{lp}"], out[f"_I{lp}"] = cx(f"l_v{p}"), cx(f"l_i{p}") + cx("_ki")
            out[f"_D{lp}"] = cx(f"_d{p}") + cx("_kd")
        else:
            p, q = lp
            out[f"_V{lp}"] = cx(f"l_v{p}") - cx(f"l_v{q}")
            out[f"_I{lp}"] = cx(f"l_i{p}") - cx(f"l_i{q}")
            out[f"_D{lp}"] = cx(f"_d{p}") - cx(f"_d{q}")
        out[f"_P{lp}"] = cx("_i2") * (1.0 / complex(ROTATION[lp]))
    return put(df, out)


def polarised(v: Cx, i: Cx, z: Cx, pol: Cx) -> tuple[Column, Column]:
    """Numerator and denominator of Im(V P*) / Im(Z I P*)."""
    return (v * pol.conj()).im, (z * i * pol.conj()).im


def phasor_features(df: DataFrame) -> DataFrame:
    """Impedance, reactance, polarised estimates, ratios and per-phase changes."""
    df = loop_phasors(df)
    z1 = lines.z1()
    raw: dict[str, Column] = {}
    for lp in LOOPS:
        v, i = cx(f"_V{lp}"), cx(f"_I{lp}")
        q = v / i
        raw[f"_q{lp}_re"], raw[f"_q{lp}_im"] = q.re, q.im
        raw[f"_a{lp}"] = i.abs()
        pols = {"tak2": cx(f"_P{lp}"), "takd": cx(f"_D{lp}")}
        if lp in GROUND:
            pols["tak0"] = cx("_i0") * 3.0
        for k, p in pols.items():
            raw[f"_n{lp}_{k}"], raw[f"_d{lp}_{k}"] = polarised(v, i, z1, p)
    for s in ("i0", "i1", "i2", "v0", "v1", "v2"):
        raw[f"_m{s}"] = cx(f"_{s}").abs()
    for p in "abc":
        for q in "iv":
            raw[f"_ml{q}{p}"], raw[f"_mf{q}{p}"] = cx(f"l_{q}{p}").abs(), cx(f"f_{q}{p}").abs()
        raw[f"_md{p}"] = cx(f"_d{p}").abs()
    df = df.withColumns(raw)
    c = F.col
    mid: dict[str, Column] = {}
    for lp in LOOPS:
        z = cx(f"_q{lp}") / z1
        mid[f"_z{lp}_re"], mid[f"_z{lp}_im"] = z.re, z.im
        mid[f"_x{lp}"] = c(f"_q{lp}_im") / c("z1x")
        for k in ("tak2", "takd") + (("tak0",) if lp in GROUND else ()):
            mid[f"_e{lp}_{k}"] = F.try_divide(c(f"_n{lp}_{k}"), c(f"_d{lp}_{k}"))
    mid["_rel2"] = cx("_i2").arg() - cx("_i1").arg()
    mid["_rel0"] = cx("_i0").arg() - cx("_i1").arg()
    mid["_imax"] = F.greatest(*[c(f"_mli{p}") for p in "abc"]) + 1e-9
    df = df.withColumns(mid)
    out: dict[str, Column] = {}
    for lp in LOOPS:
        live = c(f"_a{lp}") > CURRENT_FLOOR
        z = cx(f"_z{lp}")
        out[f"{lp}_zr"] = F.when(live, clip(z.re, -5, 5)).otherwise(0.0)
        out[f"{lp}_zi"] = F.when(live, clip(z.im, -5, 5)).otherwise(0.0)
        out[f"{lp}_react"] = F.when(live, clip(c(f"_x{lp}"), -1, 2)).otherwise(0.5)
        out[f"{lp}_absz"] = F.when(live, F.least(z.abs(), F.lit(10.0))).otherwise(0.0)
        for k in ("tak2", "takd") + (("tak0",) if lp in GROUND else ()):
            ok = F.abs(c(f"_d{lp}_{k}")) > DENOMINATOR_FLOOR
            out[f"{lp}_{k}"] = F.when(ok, clip(c(f"_e{lp}_{k}"), -1, 2)).otherwise(0.5)
    for s in ("i0", "i2", "v0", "v2"):
        out[f"{s}r"] = c(f"_m{s}") / (c(f"_m{s[0]}1") + 1e-9)
    out |= {"i2c": F.cos("_rel2"), "i2s": F.sin("_rel2"), "i0c": F.cos("_rel0"), "i0s": F.sin("_rel0")}
    for p in "abc":
        pre = c(f"_mfi{p}") + 1e-9
        out[f"i{p}_onset"] = F.least(c(f"_mli{p}") / pre, F.lit(100.0))
        out[f"v{p}_drop"] = F.least(c(f"_mlv{p}") / (c(f"_mfv{p}") + 1e-9), F.lit(5.0))
        out[f"i{p}_share"] = c(f"_mli{p}") / c("_imax")
        out[f"di{p}_rel"] = F.least(c(f"_md{p}") / pre, F.lit(100.0))
    return guard_small(df.withColumns(out))


def guard_small(df: DataFrame, ratio_col: str = "i0r", floor: float = ZERO_SEQ_FLOOR,
                zero_cols: tuple[str, ...] = ("i0c", "i0s"),
                half_cols: tuple[str, ...] = ("ag_tak0", "bg_tak0", "cg_tak0")) -> DataFrame:
    """Neutral values where the zero sequence is at rounding level."""
    small = F.col(ratio_col) < floor
    out = {k: F.when(small, 0.0).otherwise(F.col(k)) for k in zero_cols}
    out |= {k: F.when(small, 0.5).otherwise(F.col(k)) for k in half_cols}
    return df.withColumns(out)


def td_features(df: DataFrame) -> DataFrame:
    """Loop fits v ~ d*u + e*g and v ~ d*u from the normal-equation sums.

    A rank-deficient fit takes the minimum-norm solution along the one
    independent direction.
    """
    c = F.col
    raw, out = {}, {}
    for lp in LOOPS:
        vv, uu, gg, vu, vg, ug = (c(f"{s}_{lp}") for s in FIT_SUMS)
        det, tr = uu * gg - ug * ug, uu + gg
        flat = det <= tr * tr * 1e-13
        raw[f"_b0{lp}"] = F.when(flat, F.try_divide(vu, tr)).otherwise(F.try_divide(vu * gg - vg * ug, det))
        raw[f"_b1{lp}"] = F.when(flat, F.try_divide(vg, tr)).otherwise(F.try_divide(vg * uu - vu * ug, det))
        raw[f"_d1{lp}"] = vu / (uu + 1e-12)
    df = df.withColumns(raw)
    for lp in LOOPS:
        b0 = F.coalesce(c(f"_b0{lp}"), F.lit(0.0))
        b1 = F.coalesce(c(f"_b1{lp}"), F.lit(0.0))
        rest = F.greatest(c(f"vv_{lp}") - b0 * c(f"vu_{lp}") - b1 * c(f"vg_{lp}"), F.lit(0.0))
        out[f"{lp}_dtd"] = clip(b0, -1, 2)
        out[f"{lp}_drl"] = clip(c(f"_d1{lp}"), -1, 2)
        out[f"{lp}_tdres"] = F.least(F.sqrt(rest) / (F.sqrt(c(f"vv_{lp}")) + 1e-12), F.lit(5.0))
    return df.withColumns(out)


def window_features(samples: DataFrame, params: DataFrame, keys: list[str], cfg: SignalConfig,
                    deriv: str = "quadratic", group: str = "all", wanted: DataFrame | None = None,
                    labels: DataFrame | None = None) -> DataFrame:
    """Features of every complete (or every wanted, or every labelled) hop window, with the line totals and the label's columns."""
    phasors, td = group in ("phasor", "all"), group in ("td", "all")
    df = window_sums(samples, params, keys, cfg, phasors, td, deriv, wanted, labels)
    if phasors:
        df = phasor_features(df)
    if td:
        df = td_features(df)
    more = [] if labels is None else [c for c in labels.columns if c not in (*keys, "win_end")]
    return df.select(*keys, "win_end", *more, "z1r", "z1x", "z0r", "z0x", *FEATURE_GROUPS[group])


def unnormalise(df: DataFrame) -> DataFrame:
    """Per-unit loop impedances back to ohm (of the clipped values)."""
    z1 = lines.z1()
    out = {}
    for lp in LOOPS:
        z = Cx(f"{lp}_zr", f"{lp}_zi") * z1
        out[f"{lp}_zr"], out[f"{lp}_zi"] = z.re, z.im
        out[f"{lp}_absz"] = F.col(f"{lp}_absz") * z1.abs()
    return df.withColumns(out)


def ohm_tokens(samples: DataFrame, params: DataFrame, keys: list[str], cfg: SignalConfig) -> DataFrame:
    """Unclipped V/I in ohm per loop; 0 where the loop current vanishes."""
    df = loop_phasors(window_sums(samples, params, keys, cfg, phasors=True, td=False))
    df = put(df, {f"_q{lp}": cx(f"_V{lp}") / cx(f"_I{lp}") for lp in LOOPS})
    out = []
    for lp in LOOPS:
        live = cx(f"_I{lp}").abs() > CURRENT_FLOOR
        q = cx(f"_q{lp}")
        for k, v in (("zr", q.re), ("zi", q.im), ("absz", q.abs())):
            out.append(F.when(live, v).otherwise(0.0).alias(f"{lp}_{k}"))
    return df.select(*keys, "win_end", *out)


def replace_columns(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Swap the columns of ``other`` into ``df`` by key (left join)."""
    cols = [c for c in other.columns if c not in keys]
    return df.drop(*cols).join(other, keys, "left")


def oracle_loop(etype: Column, ph1: Column, ph2: Column) -> Column:
    """Faulted loop by label: ground loop, phase pair, or 'ab' for the rest."""
    return (F.when(etype.startswith("flt_1phg"), F.concat(F.substring(F.lower(ph1), 1, 1), F.lit("g")))
            .when(etype.isin("flt_2ph_shc", "flt_2phg_shc"), F.lower(ph2))
            .otherwise("ab"))


def oracle_loop_strict(etype: Column, ph1: Column, ph2: Column) -> Column:
    """Prefix form; unknown types give NULL instead of a default."""
    return (F.when(etype.startswith("flt_1phg"), F.concat(F.substring(F.lower(ph1), 1, 1), F.lit("g")))
            .when(etype.startswith("flt_2ph"), F.lower(ph2))
            .when(etype.startswith("flt_3ph"), "ab"))


assert len(FEATURES) == 77 and not math.isnan(ZERO_SEQ_FLOOR)
