"""Queries on episodes and one-ended, staged and per-episode estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultspark.config import COMPACT as CFG
from faultspark.functions.scalar import argmin_columns, half_even_sample, lookup_by_name, strip_prefix
from faultspark.operators import episodes, features, lines, locate, signal, two_ended, windows
from faultspark.plans import fixtures as fx
from faultspark.plans import sqlcx as q
from faultspark.plans import sqlsignal as ss
from faultspark.plans.registry import query, round_doubles
from faultspark.plans.signal_queries import CH, EVW, LPL, OVW, SIZES, line_totals, rec_totals
from faultspark.plans.sqlviews import EPISODES, LINE_PARAMS, SIG, err, r, with_views

LOOP_SQL = ("CASE WHEN starts_with(etype, 'flt_1phg') THEN substr(lower(ph1), 1, 1) || 'g' "
            "WHEN etype IN ('flt_2ph_shc', 'flt_2phg_shc') THEN lower(ph2) ELSE 'ab' END")
LINE_RE = "^MainLn(\\d+)-(\\d+)[AB]?$"
IS_LINE = f"(starts_with(etype, 'flt_') AND regexp_matches(target, '{LINE_RE}') AND location IS NOT NULL)"


# --- labels ------------------------------------------------------------------------

@query("filter_line_faults", f"""{with_views(EPISODES)}
SELECT sim_idx, etype, target, location FROM eps WHERE {IS_LINE}""")
def filter_line_faults(spark, sf):
    return episodes.filter_line_faults(fx.episodes(spark, sf)).select("sim_idx", "etype", "target", "location")


@query("parse_line", f"""{with_views(EPISODES)}
SELECT sim_idx, CAST(nullif(regexp_extract(target, '{LINE_RE}', 1), '') AS INTEGER) AS bus_s,
  CAST(nullif(regexp_extract(target, '{LINE_RE}', 2), '') AS INTEGER) AS bus_r, replace(etype, 'flt_', '') AS kind FROM eps""")
def parse_line(spark, sf):
    df = episodes.parse_line(fx.episodes(spark, sf))
    return df.select("sim_idx", "bus_s", "bus_r", strip_prefix(F.col("etype")).alias("kind"))


@query("oracle_loop", f"""{with_views(EPISODES)}
SELECT sim_idx, {LOOP_SQL} AS loop, CASE WHEN starts_with(etype, 'flt_1phg') THEN substr(lower(ph1), 1, 1) || 'g'
  WHEN starts_with(etype, 'flt_2ph') THEN lower(ph2) WHEN starts_with(etype, 'flt_3ph') THEN 'ab' END AS loop_strict FROM eps""")
def oracle_loop(spark, sf):
    c = F.col
    return fx.episodes(spark, sf).select(
        "sim_idx", features.oracle_loop(c("etype"), c("ph1"), c("ph2")).alias("loop"),
        features.oracle_loop_strict(c("etype"), c("ph1"), c("ph2")).alias("loop_strict"))


@query("inception_sample", f"""{with_views(EPISODES)}
SELECT sim_idx, CAST(round_even((event_start - 1.0) * 800, 0) AS INTEGER) AS nf_even, CAST(floor((event_start - 1.0) * 800) AS INTEGER) AS nf_floor FROM eps""")
def inception_sample(spark, sf):
    from faultspark.functions.scalar import floor_sample
    s = F.col("event_start")
    return fx.episodes(spark, sf).select("sim_idx", half_even_sample(s, 1.0, 800.0).alias("nf_even"),
                                         floor_sample(s, 1.0, 800.0).alias("nf_floor"))


@query("orient_local", f"""{with_views(EPISODES)}, p AS (
  SELECT *, CAST(regexp_extract(target, '{LINE_RE}', 1) AS INTEGER) AS bs, CAST(regexp_extract(target, '{LINE_RE}', 2) AS INTEGER) AS br
  FROM eps WHERE {IS_LINE}), f AS (SELECT *, (sim_idx % 5 != 3) AS has_s, (sim_idx % 6 != 5) AS has_r FROM p)
SELECT sim_idx, CAST(NOT has_s AS INTEGER) AS flip, CAST(has_s AND has_r AS INTEGER) AS two,
  CASE WHEN has_s THEN bs ELSE br END AS local_bus, {r('location / 100')} AS y_label,
  {r('CASE WHEN has_s THEN location / 100 ELSE 1 - location / 100 END')} AS y FROM f""")
def orient_local(spark, sf):
    """Measured terminals come from the label keys: some ends are absent."""
    eps = episodes.parse_line(episodes.filter_line_faults(fx.episodes(spark, sf)))
    k = F.col("sim_idx")
    cells = F.array(F.when(F.pmod(k, F.lit(5)) != 3, F.col("bus_s")), F.when(F.pmod(k, F.lit(6)) != 5, F.col("bus_r")))
    measured = eps.select("sim_idx", "target", F.explode(cells).alias("bus")).where(F.col("bus").isNotNull())
    df = episodes.orient_local(eps, measured, ["sim_idx"])
    return round_doubles(df.select("sim_idx", "flip", "two", "local_bus", "y_label", "y"))


@query("missing_lines", f"""{with_views(EPISODES)}
SELECT DISTINCT target FROM eps WHERE target NOT IN (SELECT target FROM eps WHERE {IS_LINE})""")
def missing_lines(spark, sf):
    eps = fx.episodes(spark, sf)
    return episodes.missing_lines(eps, episodes.filter_line_faults(eps).select("target").distinct())


# --- one-ended estimators -------------------------------------------------------------

def line_windows(spark, sf):
    """Wanted windows per line; the even record's label is the line's."""
    c = F.col
    eps = fx.timed_episodes(spark, sf).where((F.pmod("sim_idx", F.lit(2)) == 0) & c("etype").startswith("flt_"))
    w = windows.overlap_windows(eps, CFG)
    return w.select(F.floor(c("sim_idx") / 2).alias("line"), "etype", "r_f", "win_end", "nf", "post_ms",
                    features.oracle_loop(c("etype"), c("ph1"), c("ph2")).alias("loop"),
                    (c("etype") == "flt_3ph_shc").alias("three_ph"),
                    (F.coalesce("location", F.lit(50.0)) / 100.0).alias("y"))


LWN = f"""lwn AS (SELECT e.sim_idx // 2 AS line, e.etype, e.r_f, o.win_end, o.nf, o.post_ms, {LOOP_SQL.replace('etype', 'e.etype')} AS loop,
  e.etype = 'flt_3ph_shc' AS three_ph, coalesce(location, 50) / 100.0::DOUBLE AS y
  FROM ovw o JOIN eps e ON e.sim_idx = o.sim_idx WHERE e.sim_idx % 2 = 0 AND starts_with(e.etype, 'flt_'))"""
_PRE = f"""pp AS (SELECT s.rec, e.nf, {', '.join(f"0.125::DOUBLE * sum({c} * cos(2 * pi() * (n % 16) / 16)) AS p_{c}_re, -0.125::DOUBLE * sum({c} * sin(2 * pi() * (n % 16) / 16)) AS p_{c}_im" for c in CH)}
  FROM sig s JOIN (SELECT DISTINCT line, nf FROM lwn) e ON e.line = s.rec // 2 AND s.n >= e.nf - 18 AND s.n < e.nf - 2
  GROUP BY s.rec, e.nf HAVING count(*) = 16)"""


def _side(alias: str, tag: str, st: str) -> str:
    return ", ".join(f"{alias}.{st}_{c}_{x} AS {tag}_{st}_{c}_{x}" for c in CH for x in ("re", "im"))


_CTX = f"""ctx AS (SELECT w.*, z1r, z1x, z0r, z0x, {_side('a', 's', 'l')}, {_side('b', 'r', 'l')}, {_side('pa', 's', 'p')}, {_side('pb', 'r', 'p')}
  FROM lwn w JOIN wp a ON a.rec = 2 * w.line AND a.win_end = w.win_end LEFT JOIN wp b ON b.rec = 2 * w.line + 1 AND b.win_end = w.win_end
  LEFT JOIN pp pa ON pa.rec = 2 * w.line AND pa.nf = w.nf LEFT JOIN pp pb ON pb.rec = 2 * w.line + 1 AND pb.nf = w.nf JOIN lpl ON lpl.line = w.line)"""


def _case(values: dict[str, q.S]) -> q.S:
    return q.S(*["(CASE loop " + " ".join(f"WHEN '{lp}' THEN {v[k]}" for lp, v in values.items()) + " END)" for k in (0, 1)])


def _loopq(ph: dict[str, q.S], extra: q.S | None) -> q.S:
    out = {}
    for lp in ss.LOOPS:
        if lp[1] == "g":
            out[lp] = ph[lp[0]] + extra if extra else ph[lp[0]]
        else:
            out[lp] = ph[lp[0]] - ph[lp[1]]
    return _case(out)


def _classical_stage() -> str:
    z1, z0 = q.S("z1r", "z1x"), q.S("z0r", "z0x")
    v = q.var
    s1 = {"k0": (z0 - z1) / (z1 * 3)}
    for t in "sr":
        for c in CH:
            s1[f"d{t}_{c}"] = v(f"{t}_l_{c}") - v(f"{t}_p_{c}")
    s2 = {}
    s2["I0"], _, s2["I2"] = q.seq(*[v(f"s_l_i{p}") for p in "abc"])
    for t in "sr":
        for k in "iv":
            zero, pos, _n = q.seq(*[v(f"d{t}_{k}{p}") for p in "abc"])
            s2[f"{t}0{k}"], s2[f"{t}1{k}"] = zero, pos
    s3 = {"V": _loopq({p: v(f"s_l_v{p}") for p in "abc"}, None)}
    s3["I"] = _loopq({p: v(f"s_l_i{p}") for p in "abc"}, v("k0") * v("I0") * 3)
    s3["D"] = _loopq({p: v(f"ds_i{p}") for p in "abc"}, v("k0") * v("s0i") * 3)
    one, a, aa = q.const(1), q.A, q.AA
    rot = {"ag": one, "bg": aa, "cg": a, "ab": one - aa, "bc": aa - a, "ca": a - one}
    s3["P2"] = _case({lp: v("I2") / rot[lp] for lp in ss.LOOPS})
    neg = q.const(-1)
    for name, t, s in (("ZSA", "s", 1), ("ZSB", "r", 1), ("Z0SA", "s", 0), ("Z0SB", "r", 0)):
        i = v(f"{t}{s}i")
        z = (v(f"{t}{s}v") * neg) / i
        s3[name] = q.S(f"(CASE WHEN {i.abs()} > 1e-9 THEN {z.re} END)", f"(CASE WHEN {i.abs()} > 1e-9 THEN {z.im} END)")
    s4 = {"qv": v("V") / (z1 * v("I")), "bz": v("ZSB") / z1, "az": (v("ZSA") + v("ZSB")) / z1, "dz": v("D") / (z1 * v("I"))}
    s5 = {"K1": v("bz") + v("qv") + one, "K2": v("qv") * (v("bz") + one), "K3": v("dz") * (v("az") + one)}
    return q.staged("cl", "ctx", [s1, s2, s3, s4, s5])


def _tak(pol: q.S) -> str:
    z1 = q.S("z1r", "z1x")
    den = (z1 * q.var("I") * pol.conj()).im
    return f"(CASE WHEN abs({den}) > 1e-12 THEN {(q.var('V') * pol.conj()).im} / nullif({den}, 0) END)"


def _cl2() -> str:
    z0 = q.S("z0r", "z0x")
    st = [[f"CASE WHEN {q.var('I').abs()} > 1e-9 THEN {(q.var('V') / q.var('I')).im} / z1x END AS R0",
           f"{_tak(q.var('D'))} AS Ta", f"{_tak(q.var('P2'))} AS Tb",
           "K1_re - K3_re * K1_im / nullif(K3_im, 0) AS pq", "K2_re - K3_re * K2_im / nullif(K3_im, 0) AS qq"],
          ["R0 AS R", "Ta AS T", "CASE WHEN three_ph THEN R0 ELSE Tb END AS T2", "pq * pq - 4 * qq AS disc"],
          ["(pq - sqrt(greatest(disc, 0))) / 2 AS ra", "(pq + sqrt(greatest(disc, 0))) / 2 AS rb"],
          ["""CASE WHEN abs(K3_im) < 1e-12 OR disc < 0 THEN NULL
              WHEN ra BETWEEN -0.1 AND 1.1 AND rb BETWEEN -0.1 AND 1.1 THEN CASE WHEN abs(ra - 0.5) <= abs(rb - 0.5) THEN ra ELSE rb END
              WHEN ra BETWEEN -0.1 AND 1.1 THEN ra WHEN rb BETWEEN -0.1 AND 1.1 THEN rb END AS E"""]]
    d = "0.5::DOUBLE"
    for k in range(3):
        ratio = (q.var("Z0SB") + z0 * f"(1 - {d})") / (q.var("Z0SA") + z0 + q.var("Z0SB"))
        st.append([f"atan2({ratio.im}, {ratio.re}) AS th{k}"])
        pol = q.var("I0") * 3 * q.S(f"cos(th{k})", f"(-sin(th{k}))")
        st.append({f"pol{k}": pol})
        st.append([f"{_tak(q.var(f'pol{k}'))} AS tk{k}"])
        st.append([f"coalesce({q.clip(f'tk{k}', -1, 2)}, 0.5) AS dk{k}"])
        d = f"dk{k}"
    st.append(["CASE WHEN loop IN ('ab', 'bc', 'ca') THEN T WHEN Z0SA_re IS NOT NULL AND Z0SB_re IS NOT NULL THEN dk2 END AS MT"])
    return q.staged("cl2", "cl", st)


CLASSICAL = [*ss.BASE, ss.WINDOW_PHASORS, LPL, EPISODES, OVW, LWN, _PRE, _CTX, _classical_stage(), _cl2()]


def classical(spark, sf):
    return locate.classical_estimates(fx.two_terminal(spark, sf), line_windows(spark, sf), line_totals(spark, sf), ["line"], CFG)


@query("classical_estimates", f"""{with_views(*CLASSICAL)}
SELECT line, win_end, loop, {', '.join(f'{r(q.clip(m, -1, 2), 4)} AS {m}' for m in locate.METHODS)} FROM cl2""")
def classical_estimates(spark, sf):
    return round_doubles(classical(spark, sf).select("line", "win_end", "loop", *locate.METHODS), 4)


@query("source_impedances", f"""{with_views(*CLASSICAL[:-1])}
SELECT line, win_end, {', '.join(f'{r(f"{z}_{x}", 3)} AS {z}_{x}' for z in ('ZSA', 'ZSB', 'Z0SA', 'Z0SB') for x in ('re', 'im'))} FROM cl""")
def source_impedances(spark, sf):
    df = locate.loop_context(locate.window_context(
        fx.two_terminal(spark, sf), line_windows(spark, sf), line_totals(spark, sf), ["line"], CFG))
    cols = [f"{z}_{x}" for z in ("ZSA", "ZSB", "Z0SA", "Z0SB") for x in ("re", "im")]
    return round_doubles(locate.source_impedances(df).select("line", "win_end", *cols), 3)


@query("bolted_check", f"""{with_views(*CLASSICAL)}, e AS (
  SELECT {', '.join(f"{err(m)} AS e_{m}" for m in locate.METHODS)} FROM cl2
  WHERE r_f <= 8 AND NOT regexp_matches(etype, 'incipient|hif') AND post_ms >= 25)
SELECT method, count(*) AS n, {r('avg(e)', 4)} AS mae, avg(e) <= 3 AS pass FROM (
  UNPIVOT e ON e_R, e_T, e_T2, e_MT, e_E INTO NAME method VALUE e) GROUP BY method""")
def bolted_check(spark, sf):
    """Gate: low-resistance late windows must stay within 3 % per method.

    The stand-in labels carry resistances in steps of two ohm, hence the bound.
    """
    from faultspark.functions.scalar import score
    df = classical(spark, sf).where(locate.bolted(8.0))
    e = df.select(*[score(F.col(m), F.col("y")).alias(f"e_{m}") for m in locate.METHODS])
    long = e.unpivot([], [f"e_{m}" for m in locate.METHODS], "method", "e")
    out = long.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"), (F.avg("e") <= 3.0).alias("pass"))
    return round_doubles(out, 4)


def _cond_sql() -> str:
    z1 = q.S("z1r", "z1x")
    v = q.var
    fi = _case({f"{p}g": v(f"s_l_i{p}") + v(f"r_l_i{p}") for p in "abc"})
    f, z, m = v("IFc") / v("I"), v("V") / v("I"), v("D") / v("I")
    st = [{"IFc": fi}, {"f": f, "zz": z, "m": m}]
    st.append([f"{z1.abs()} AS absZ", f"{z1.arg()} AS th", f"{v('f').abs()} AS ratio_IF_I", f"{v('f').arg()} AS b", f"{v('m').arg()} AS bh_T",
               "0.0::DOUBLE AS bh_R"])
    st.append(["r_f / absZ AS rho", "degrees(b) AS beta_deg"])
    last = []
    for k in "RT":
        t = q.S(f"cos(bh_{k})", f"(-sin(bh_{k}))")
        last += [f"{(v('zz') * t).im} / {(z1 * t).im} - y AS e_obs_{k}",
                 f"rho * ratio_IF_I * sin(b - bh_{k}) / sin(th - bh_{k}) AS e_pred_{k}", f"ratio_IF_I / sin(th - bh_{k}) AS kappa_{k}",
                 f"degrees(atan2(sin(b - bh_{k}), cos(b - bh_{k}))) AS angerr_{k}_deg"]
    st += [last, ["degrees(asin(least(1.0, 0.05::DOUBLE / greatest(rho * abs(kappa_T), 1e-12)))) AS Dreq_deg"]]
    return q.staged("cond", "cl", st, "WHERE etype = 'flt_1phg_shc' AND post_ms >= 25 AND r_l_ia_re IS NOT NULL")


_COND_COLS = ["absZ", "rho", "ratio_IF_I", "beta_deg"] + [f"{k}_{m}{x}" for m in "RT" for k, x in (
    ("e_obs", ""), ("e_pred", ""), ("kappa", ""), ("angerr", "_deg"))] + ["Dreq_deg"]


def conditioning_windows(spark, sf):
    return locate.conditioning(fx.two_terminal(spark, sf), line_windows(spark, sf), line_totals(spark, sf), ["line"], CFG)


@query("conditioning", f"""{with_views(*CLASSICAL[:-1], _cond_sql())}
SELECT line, win_end, {', '.join(f'{r(c, 3)} AS {c}' for c in _COND_COLS)} FROM cond""")
def conditioning(spark, sf):
    return round_doubles(conditioning_windows(spark, sf).select("line", "win_end", *_COND_COLS), 3)


@query("conditioning_summary", f"""{with_views(*CLASSICAL[:-1], _cond_sql())}
SELECT CAST(line % 2 AS INTEGER) AS grid, count(*) AS n, count(DISTINCT line) AS episodes, {r('quantile_cont(abs(e_obs_R) * 100, 0.5)', 3)} AS med_abs_eobs_R,
  {r('quantile_cont(abs(e_obs_R - e_pred_R) * 100, 0.9)', 3)} AS ident_R_p90, {r('quantile_cont(rho, 0.5)')} AS rho_med,
  {r('quantile_cont(abs(kappa_T), 0.5)', 4)} AS kappaT_med, {r('quantile_cont(abs(angerr_T_deg), 0.9)', 3)} AS angerr_T_p90,
  {r('avg(CAST(Dreq_deg < 1 AS INTEGER))')} AS share_dreq_lt1 FROM cond GROUP BY 1""")
def conditioning_summary(spark, sf):
    from faultspark.operators.report import conditioning_report
    df = conditioning_windows(spark, sf).withColumn("grid", F.pmod("line", F.lit(2)).cast("int"))
    out = conditioning_report(df, ["grid"], ["line"])
    out = out.select("grid", "n", "episodes", "med_abs_eobs_R", "ident_R_p90", "rho_med", "kappaT_med", "angerr_T_p90", "share_dreq_lt1")
    from faultspark.plans.registry import round_cols
    return round_cols(round_cols(round_cols(out, ["rho_med", "share_dreq_lt1"]), ["kappaT_med"], 4),
                      ["med_abs_eobs_R", "ident_R_p90", "angerr_T_p90"], 3)


@query("td_one_ended", f"""{with_views(*ss.features_cte(phasor=False), EPISODES, OVW)}
SELECT f.rec, f.win_end, loop, {r("CASE loop " + ' '.join(f"WHEN '{lp}' THEN {lp}_dtd" for lp in ss.LOOPS) + " END", 4)} AS est
FROM ft f JOIN (SELECT o.sim_idx, o.win_end, {LOOP_SQL.replace('etype', 'e.etype')} AS loop FROM ovw o JOIN eps e ON e.sim_idx = o.sim_idx) w
  ON w.sim_idx = f.rec AND w.win_end = f.win_end""")
def td_one_ended(spark, sf):
    """The time-domain fit of the labelled loop, picked by column name."""
    c = F.col
    w = windows.overlap_windows(fx.timed_episodes(spark, sf), CFG).select(
        c("sim_idx").alias("rec"), "win_end", features.oracle_loop(c("etype"), c("ph1"), c("ph2")).alias("loop"))
    feat = features.window_features(fx.sig(spark, sf), rec_totals(spark, sf), ["rec"], CFG, group="td", wanted=w)
    df = feat.join(w, ["rec", "win_end"])
    return round_doubles(df.select("rec", "win_end", "loop", lookup_by_name(features.LOOPS, c("loop"), "_dtd").alias("est")), 4)


@query("min_impedance_loop", f"""{with_views(*ss.features_cte(td=False))}
SELECT rec, win_end, minloop, {r("CASE minloop " + ' '.join(f"WHEN '{lp}' THEN {lp}_react" for lp in ss.LOOPS) + " END", 4)} AS est
FROM (SELECT *, CASE {' '.join(f"WHEN {lp}_absz <= least({', '.join(f'{x}_absz' for x in ss.LOOPS)}) THEN '{lp}'" for lp in ss.LOOPS)} END AS minloop FROM feat)""")
def min_impedance_loop(spark, sf):
    """Label-free reactance: the loop with the smallest impedance."""
    df = features.window_features(fx.sig(spark, sf), rec_totals(spark, sf), ["rec"], CFG, group="phasor")
    df = df.withColumn("minloop", argmin_columns(features.LOOPS, "_absz"))
    return round_doubles(df.select("rec", "win_end", "minloop",
                                   lookup_by_name(features.LOOPS, F.col("minloop"), "_react").alias("est")), 4)


# --- per-episode locator and line impedance -----------------------------------------------

def line_episodes(spark, sf):
    eps = fx.episodes(spark, sf).where(F.pmod("sim_idx", F.lit(2)) == 0)
    return eps.select(F.floor(F.col("sim_idx") / 2).alias("line"), half_even_sample(F.col("event_start"), 1.0, 800.0).alias("nf"))


def _cyc(name: str, lo: str) -> str:
    return ", ".join(f"0.125::DOUBLE * sum({c} * cos(2 * pi() * (n % 16) / 16)) FILTER (n >= {lo} AND n < {lo} + 16) AS {name}_{c}_re, "
                     f"-0.125::DOUBLE * sum({c} * sin(2 * pi() * (n % 16) / 16)) FILTER (n >= {lo} AND n < {lo} + 16) AS {name}_{c}_im" for c in CH)


def _episode_sql() -> list[str]:
    v = q.var
    le = "le AS (SELECT sim_idx // 2 AS line, CAST(round_even((event_start - 1.0) * 800, 0) AS INTEGER) AS nf FROM eps WHERE sim_idx % 2 = 0)"
    ep = f"ep AS (SELECT s.rec, any_value(nf) AS nf, {_cyc('p', 'nf - 32')}, {_cyc('f', 'nf + 16')} FROM sig s JOIN le ON le.line = s.rec // 2 GROUP BY s.rec HAVING max(n) >= any_value(nf) + 31)"
    both = f"eb AS (SELECT a.rec // 2 AS line, {', '.join(_side('a', 's', k) + ', ' + _side('b', 'r', k) for k in 'pf')} FROM ep a JOIN ep b ON b.rec = a.rec + 1 WHERE a.rec % 2 = 0)"
    out = {}
    for t in "sr":
        for k in "pf":
            for c in "vi":
                out[f"{c}{t}{k}"] = q.seq(*[v(f"{t}_{k}_{c}{p}") for p in "abc"])[1]
    s2 = {}
    s2["z"] = (v("vsp") - v("vrp")) / ((v("isp") - v("irp")) * 0.5)
    s3 = {"d": (v("vsf") - v("vrf") + v("z") * v("irf")) / (v("z") * (v("isf") + v("irf")))}
    return [SIG, LINE_PARAMS, LPL, EPISODES, le, ep, both, q.staged("el", "eb", [out, s2, s3])]


EPISODE_SQL = _episode_sql()


def episode_locator_df(spark, sf):
    return two_ended.episode_locator(fx.two_terminal(spark, sf), line_episodes(spark, sf), ["line"], CFG)


@query("episode_locator", f"""{with_views(*EPISODE_SQL)}
SELECT line, {r('z_re', 4)} AS z_re, {r('z_im', 4)} AS z_im, {r('d_re', 4)} AS d, {r('d_im', 4)} AS d_im,
 {r(f"{(q.var('isp') + q.var('irp')).abs()} / ({q.var('isp').abs()} + 1e-9)", 4)} AS preload_ratio FROM el""")
def episode_locator(spark, sf):
    return round_doubles(episode_locator_df(spark, sf).drop("i_pre", "i_post"), 4)


def corridors(spark, sf):
    """Lines grouped seven ways, each with several episodes."""
    per = episode_locator_df(spark, sf).withColumn("corridor", F.pmod("line", F.lit(7)))
    cols = ["length_km", "z1r", "z1x", "z0r", "z0x"]
    plate = line_totals(spark, sf).groupBy(F.pmod("line", F.lit(7)).alias("corridor")).agg(*[F.avg(x).alias(x) for x in cols])
    return per, plate


_COR = "cor AS (SELECT line % 7 AS corridor, avg(length_km) AS length_km, avg(z1r) AS z1r, avg(z1x) AS z1x, avg(z0r) AS z0r, avg(z0x) AS z0x FROM lpl GROUP BY 1), ec AS (SELECT line % 7 AS corridor, line, z_re, z_im FROM el WHERE z_re IS NOT NULL)"


@query("identify_impedance", f"""{with_views(*EPISODE_SQL, _COR)}, idn AS (
  SELECT corridor, quantile_cont(z_re, 0.5) AS re, quantile_cont(z_im, 0.5) AS im, count(*) AS n FROM
   (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY line) AS k FROM ec) WHERE k <= 10 GROUP BY corridor)
SELECT c.corridor, {r('length_km')} AS length_km, {r('coalesce(re, z1r)', 4)} AS z1r, {r('coalesce(im, z1x)', 4)} AS z1x, {r('coalesce(z0r * re / z1r, z0r)', 3)} AS z0r,
  {r('z0x', 4)} AS z0x, coalesce(n, 0) AS n_ident FROM cor c LEFT JOIN idn i ON i.corridor = c.corridor""")
def identify_impedance(spark, sf):
    per, plate = corridors(spark, sf)
    out = locate.identify_impedance(per, plate, ["corridor"], ["line"])
    from faultspark.plans.registry import round_cols
    return round_cols(round_cols(round_cols(out, ["z1r", "z1x", "z0x"], 4), ["z0r"], 3), ["length_km"])


@query("median_impedance", f"""{with_views(*EPISODE_SQL, _COR)}
SELECT corridor, {r('quantile_cont(z_re, 0.5)', 4)} AS z_re, {r('quantile_cont(z_im, 0.5)', 4)} AS z_im FROM ec GROUP BY corridor""")
def median_impedance(spark, sf):
    per, _ = corridors(spark, sf)
    return round_doubles(locate.median_impedance(per, ["corridor"]), 4)


_ZR = "sqrt(z_re * z_re + z_im * z_im) / sqrt(z1r * z1r + z1x * z1x)"


@query("compare_impedance", f"""{with_views(*EPISODE_SQL)}
SELECT line, {r(_ZR, 4)} AS ratio_abs, {r('degrees(atan2(z1x, z1r))', 3)} AS ang_np, {r('degrees(atan2(z_im, z_re))', 3)} AS ang_id
FROM el JOIN lpl USING (line)""")
def compare_impedance(spark, sf):
    df = locate.compare_impedance(episode_locator_df(spark, sf).select("line", "z_re", "z_im"), line_totals(spark, sf), ["line"])
    from faultspark.plans.registry import round_cols
    return round_cols(round_cols(df.select("line", "ratio_abs", "ang_np", "ang_id"), ["ratio_abs"], 4), ["ang_np", "ang_id"], 3)


@query("impedance_deviation", f"""{with_views(*EPISODE_SQL)}, dv AS (SELECT abs({_ZR} - 1) AS dev FROM el JOIN lpl USING (line))
SELECT count(*) AS lines, sum(CAST(dev > 0.05 AS INTEGER)) AS n_above, {r('max(dev)', 3)} AS max_dev, {r('quantile_cont(dev, 0.5)', 4)} AS median_dev FROM dv""")
def impedance_deviation(spark, sf):
    df = locate.compare_impedance(episode_locator_df(spark, sf).select("line", "z_re", "z_im"), line_totals(spark, sf), ["line"])
    from faultspark.plans.registry import round_cols
    return round_cols(round_cols(locate.impedance_deviation(df), ["max_dev"], 3), ["median_dev"], 4)


# --- staged locator --------------------------------------------------------------------------

HWN = f"""hwn AS (SELECT sim_idx // 2 AS line, nf, CAST(4 * k + 40 AS INTEGER) AS win_end, (4 * k + 40 - nf) / 800.0::DOUBLE * 1000 AS tau_ms FROM (
  SELECT *, CAST(round_even((event_start - 1.0) * 800, 0) AS INTEGER) AS nf, unnest(range(0, (size - 40) // 4 + 1)) AS k FROM eps
    JOIN (SELECT sim_idx // 2 AS line, min(size) AS size FROM {SIZES} GROUP BY 1 HAVING count(*) = 2) z ON z.line = eps.sim_idx // 2 WHERE sim_idx % 2 = 0)
  WHERE 4 * k + 40 > nf AND 4 * k < nf + CASE WHEN contains(etype, 'incipient') THEN 4 ELSE 8000 END)"""


def staged_windows(spark, sf):
    return windows.hop_windows(fx.line_episodes(spark, sf), CFG).select("line", "nf", "win_end", "tau_ms")


def _staged_sql() -> str:
    """Residuals from explicit regressions on time, then a 2x2 system."""
    sigs = [f"{k}{t}_{m}" for k in "vi" for t in "sr" for m in ("al", "be")]
    views = ss.modal_cte()[:4] + [
        EPISODES, HWN,
        "wr AS (SELECT h.line, h.win_end, h.nf, h.tau_ms, CAST(unnest(range(greatest(h.win_end - 40, CASE WHEN tau_ms >= 21 THEN h.win_end - 16 ELSE h.nf + 1 END), h.win_end)) AS INTEGER) AS n FROM hwn h WHERE tau_ms >= 3)",
        f"sr AS (SELECT w.line, w.win_end, tau_ms, w.n, (w.n - w.win_end) / 16.0::DOUBLE AS t, cos(2 * pi() * (w.n % 16) / 16) AS c, sin(2 * pi() * (w.n % 16) / 16) AS s, {', '.join(sigs)} FROM wr w JOIN md USING (line, n))",
        f"rg AS (SELECT line, win_end, count(*) AS k, {', '.join(f'regr_slope({x}, t) AS a_{x}, regr_intercept({x}, t) AS b_{x}' for x in ['c', 's', *sigs])} FROM sr WHERE tau_ms < 21 GROUP BY 1, 2)",
        f"rs AS (SELECT line, win_end, k, {', '.join(f'{x} - a_{x} * t - b_{x} AS {x}' for x in ['c', 's', *sigs])} FROM sr JOIN rg USING (line, win_end) WHERE tau_ms < 21)",
        f"n2 AS (SELECT line, win_end, any_value(k) AS k, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, {', '.join(f'sum({x} * c) AS c_{x}, sum({x} * s) AS s_{x}' for x in sigs)} FROM rs GROUP BY 1, 2)",
        f"ph AS (SELECT line, win_end, {', '.join(f'(c_{x} * ss - s_{x} * cs) / (cc * ss - cs * cs) AS {x}_re, -(s_{x} * cc - c_{x} * cs) / (cc * ss - cs * cs) AS {x}_im' for x in sigs)} FROM n2 WHERE k >= 4 AND cc * ss - cs * cs > 1e-12 UNION ALL "
        f"SELECT line, win_end, {', '.join(f'0.125::DOUBLE * sum({x} * c) AS {x}_re, -0.125::DOUBLE * sum({x} * s) AS {x}_im' for x in sigs)} FROM sr WHERE tau_ms >= 21 GROUP BY 1, 2)"]
    j = q.const(1j)
    pos = {k: (q.var(f"{k}_al") + j * q.var(f"{k}_be")) * "0.5::DOUBLE" for k in ("vs", "is", "vr", "ir")}
    z = q.S("z1r", "z1x")
    tail = q.staged("pe", "(SELECT * FROM ph JOIN lpl USING (line))", [
        {"num": pos["vs"] - pos["vr"] + z * pos["ir"], "den": z * (pos["is"] + pos["ir"])}, {"d": q.var("num") / q.var("den")}])
    return f"""{with_views(*views, tail)}
SELECT h.line, h.win_end, {r('tau_ms', 3)} AS tau_ms, {r('CASE WHEN tau_ms < 3 THEN 0.5 ELSE greatest(-1000, least(1000, d_re)) END', 3)} AS est
FROM hwn h LEFT JOIN pe ON pe.line = h.line AND pe.win_end = h.win_end WHERE tau_ms < 3 OR d_re IS NOT NULL"""


@query("staged_locator", _staged_sql())
def staged_locator(spark, sf):
    """Phasor, least-squares or mid-line estimate by time after inception."""
    df = locate.staged_locator(fx.two_terminal(spark, sf), staged_windows(spark, sf), line_totals(spark, sf), ["line"], CFG)
    est = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.col("est"))).alias("est")
    return round_doubles(df.where(F.col("est").isNotNull()).select("line", "win_end", "tau_ms", est), 3)


_MODE = {f"{k}{t}_{m}": e for k in "iv" for t, a in (("s", "s"), ("r", "b")) for m, e in (
    ("al", f"(2 * {a}.{k}a - {a}.{k}b - {a}.{k}c) / 3.0::DOUBLE"), ("be", f"({a}.{k}b - {a}.{k}c) / sqrt(3.0::DOUBLE)"))}


def _hybrid_sql() -> str:
    views = [*ss.td_cte(), ss.LEN, ss.WIN_ENDS, ss.WS, ss.WINDOW_PHASORS]
    tp = f"""tp AS (SELECT a.rec // 2 AS line, a.win_end, {', '.join(f'a.l_{c}_{x} AS s_{c}_{x}, b.l_{c}_{x} AS r_{c}_{x}' for c in CH for x in ('re', 'im'))}
      FROM wp a JOIN wp b ON b.rec = a.rec + 1 AND b.win_end = a.win_end WHERE a.rec % 2 = 0)"""
    p = {f"{k}{t}": q.seq(*[q.var(f"{t}_{k}{x}") for x in "abc"])[1] for k in "iv" for t in "sr"}
    z = q.S("z1r", "z1x")
    num, den = p["vs"] - p["vr"] + z * p["ir"], z * (p["is"] + p["ir"])
    return f"""{with_views(*views, tp, EPISODES, HWN)}
SELECT h.line, h.win_end, {r(f"CASE WHEN tau_ms >= 21 THEN {(num / den).re} ELSE td_est END", 4)} AS est
FROM hwn h JOIN td ON td.line = h.line AND td.win_end = h.win_end JOIN tp ON tp.line = h.line AND tp.win_end = h.win_end JOIN lpl ON lpl.line = h.line"""


@query("phasor_or_td", _hybrid_sql())
def phasor_or_td(spark, sf):
    """Diagnostic choice: phasor from 21 ms, time domain before."""
    s, p = fx.two_terminal(spark, sf), line_totals(spark, sf)
    td = two_ended.td_estimate(s, p, ["line"], CFG).select("line", "win_end", "td_est")
    ph = two_ended.phasor_estimate(s, p, ["line"], CFG)
    df = staged_windows(spark, sf).join(td, ["line", "win_end"]).join(ph, ["line", "win_end"])
    return round_doubles(df.select("line", "win_end", locate.phasor_or_td(F.col("tau_ms"), F.col("ph_est"), F.col("td_est")).alias("est")), 4)
