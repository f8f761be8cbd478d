"""Queries on samples: windows, phasors, derivatives, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultspark.config import COMPACT as CFG
from faultspark.functions.cplx import cx, neg_seq, pos_seq, put, zero_seq
from faultspark.operators import episodes, features, lines, moments, report, signal, two_ended, windows
from faultspark.operators.blocks import halo_blocks, owned_samples
from faultspark.plans import fixtures as fx
from faultspark.plans import sqlcx as q
from faultspark.plans import sqlsignal as ss
from faultspark.plans.registry import query, round_cols, round_doubles
from faultspark.plans.sqlviews import EPISODES, LINE_PARAMS, SIG, r, with_views

CH = signal.CHANNELS


def line_totals(spark, sf):
    return lines.totals(fx.line_params(spark, sf, "line"))


def rec_totals(spark, sf):
    return lines.totals(fx.line_params(spark, sf))


def td_scored(spark, sf):
    """Flagship: two-ended estimate per window and its error by line."""
    est = two_ended.td_estimate(fx.two_terminal(spark, sf), line_totals(spark, sf), ["line"], CFG)
    y = (F.pmod("line", F.lit(9)) + 1) / 10.0
    from faultspark.functions.scalar import score
    return (est.withColumn("e", score(F.col("td_est"), y)).groupBy("line")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"), F.max("e").alias("worst")))


# --- samples -----------------------------------------------------------------

@query("record_samples", f"""{with_views(SIG)}
SELECT rec, n, {', '.join(f'{r(c, 9)} AS {c}' for c in CH)} FROM sig""")
def record_samples(spark, sf):
    return round_doubles(fx.sig(spark, sf).select("rec", "n", *CH), 9)


_D3 = ", ".join(f"{r(f'{c}_d', 4)} AS {c}_d" for c in ("ia", "ib", "ic"))


@query("derivative_quadratic", f"{with_views(SIG, ss.deriv())} SELECT rec, n, {_D3} FROM dv")
def derivative_quadratic(spark, sf):
    df = signal.deriv_quadratic(halo_blocks(fx.sig(spark, sf), CFG), signal.CURRENTS, ["rec", "blk"], CFG)
    return round_doubles(owned_samples(df, CFG).select("rec", "n", "ia_d", "ib_d", "ic_d"), 4)


_CEN = ", ".join(
    f"""{r(f'''CASE WHEN lead({c}) OVER w IS NULL THEN ({c} - lag({c}) OVER w) * 800
 WHEN lag({c}) OVER w IS NULL THEN (lead({c}) OVER w - {c}) * 800
 ELSE (lead({c}) OVER w - lag({c}) OVER w) * 400 END''', 4)} AS {c}_d""" for c in ("ia", "va"))


@query("derivative_central", f"""{with_views(SIG)}
SELECT rec, n, {_CEN} FROM sig WINDOW w AS (PARTITION BY rec ORDER BY n)""")
def derivative_central(spark, sf):
    df = signal.deriv_central(halo_blocks(fx.sig(spark, sf), CFG), ["ia", "va"], ["rec", "blk"], CFG)
    return round_doubles(owned_samples(df, CFG).select("rec", "n", "ia_d", "va_d"), 4)


@query("delta_cycle", f"""{with_views(SIG)}
SELECT rec, n, {r('ia - lag(ia, 16) OVER w')} AS ia_g, {r('vb - lag(vb, 16) OVER w')} AS vb_g
FROM sig WINDOW w AS (PARTITION BY rec ORDER BY n)""")
def delta_cycle(spark, sf):
    df = signal.delta_cycle(halo_blocks(fx.sig(spark, sf), CFG), ["ia", "vb"], ["rec", "blk"], CFG)
    return round_doubles(owned_samples(df, CFG).select("rec", "n", "ia_g", "vb_g"))


_MODES = ("is_al", "is_be", "vs_al", "vs_be", "ir_al", "ir_be", "vr_al", "vr_be")


@query("clarke_modes", f"""{with_views(*ss.modal_cte()[:4])}
SELECT line, count(*) AS n, {', '.join(f"{r(f'sum({x} * (n % 7 + 1))', 4)} AS {x}" for x in _MODES)} FROM md GROUP BY line""")
def clarke_modes(spark, sf):
    """Weighted sums of each line's modal quantities."""
    df = signal.pair_terminals(halo_blocks(fx.two_terminal(spark, sf), CFG), ["line"], CH)
    df = owned_samples(signal.modal_inputs(df), CFG)
    weight = F.pmod("n", F.lit(7)) + 1
    return round_doubles(df.groupBy("line").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(x) * weight).alias(x) for x in _MODES]), 4)


@query("rms_prefix", f"""{with_views(SIG)}
SELECT rec, {', '.join(f'{r(f"sqrt(avg({c} * {c}))")} AS rms_{c}' for c in CH)} FROM sig WHERE n < 72 GROUP BY rec""")
def rms_prefix(spark, sf):
    return round_doubles(signal.rms_prefix(fx.sig(spark, sf), ["rec"], CH, 0.09, CFG))


def _noise_sql(c: str) -> str:
    u = lambda tag: (f"(((('0x' || substr(md5('7|' || rec || '|{c}|' || n || '|{tag}'), 1, 8))::BIGINT)::DOUBLE + 0.5)"  # noqa: E731
                     " / 4294967296.0::DOUBLE)")
    return f"{c} + (rms_{c} + 1e-12) * 0.01::DOUBLE * sqrt(-2 * ln({u('r')})) * cos(2 * pi() * {u('t')})"


@query("add_noise", f"""{with_views(SIG, 'rms AS (SELECT rec, sqrt(avg(ia * ia)) AS rms_ia, sqrt(avg(vb * vb)) AS rms_vb FROM sig WHERE n < 72 GROUP BY rec)')}
SELECT rec, n, {r(_noise_sql('ia'))} AS ia, {r(_noise_sql('vb'))} AS vb FROM sig JOIN rms USING (rec)""")
def add_noise(spark, sf):
    df = signal.add_noise(fx.sig(spark, sf).select("rec", "n", "ia", "vb"), ["rec"], ["ia", "vb"], 40.0, 7, CFG, portable=True)
    return round_doubles(df.select("rec", "n", "ia", "vb"))


@query("shift_record", f"""{with_views(SIG, ss.LEN)}
SELECT rec, CAST((n - 5 + last_n + 1) % (last_n + 1) AS INTEGER) AS n, {r('ia')} AS ia FROM sig JOIN len USING (rec)""")
def shift_record(spark, sf):
    return round_doubles(signal.shift_record(fx.sig(spark, sf).select("rec", "n", "ia"), ["rec"], -5))


# --- windows from labels -------------------------------------------------------

_INC = "contains(etype, 'incipient')"
EVW = f"""evw AS (SELECT sim_idx, etype, nf, CAST(tau AS INTEGER) AS tau, CAST(nf + round_even(tau / 1000.0::DOUBLE * 800, 0) AS INTEGER) AS win_end
 FROM (SELECT sim_idx, etype, CAST(round_even((event_start - 1.0) * 800, 0) AS INTEGER) AS nf,
       unnest(range(5, CASE WHEN {_INC} THEN 51 ELSE 81 END, 5)) AS tau FROM eps))"""
SIZES = "(SELECT l_suppkey AS sim_idx, count(*) AS size FROM lineitem GROUP BY 1)"
OVW = f"""ovw AS (SELECT sim_idx, etype, nf, CAST(e AS INTEGER) AS win_end, (e - nf) / 800.0::DOUBLE * 1000 AS post_ms
 FROM (SELECT sim_idx, etype, CAST(floor((event_start - 1.0) * 800) AS INTEGER) AS nf,
         CASE WHEN {_INC} THEN floor(duration * 800) ELSE 24 END AS act, unnest(range(40, size + 1, 4)) AS e FROM eps JOIN {SIZES} USING (sim_idx))
 WHERE e > nf AND e - 40 < nf + act)"""


@query("event_windows", f"{with_views(EPISODES, EVW)} SELECT sim_idx, nf, tau, win_end FROM evw")
def event_windows(spark, sf):
    return windows.event_windows(fx.episodes(spark, sf), CFG).select("sim_idx", "nf", "tau", "win_end")


@query("overlap_windows", f"{with_views(EPISODES, OVW)} SELECT sim_idx, nf, win_end, {r('post_ms')} AS post_ms FROM ovw")
def overlap_windows(spark, sf):
    df = windows.overlap_windows(fx.timed_episodes(spark, sf), CFG).select("sim_idx", "nf", "win_end", "post_ms")
    return round_doubles(df)


@query("hop_windows", f"""{with_views(EPISODES)}
SELECT sim_idx, CAST(k AS BIGINT) AS k, {r('(4 * k + 40 - nf) / 800.0::DOUBLE * 1000')} AS tau_ms
FROM (SELECT *, CAST(round_even((event_start - 1.0) * 800, 0) AS INTEGER) AS nf, unnest(range(0, (size - 40) // 4 + 1)) AS k FROM eps JOIN {SIZES} USING (sim_idx))
WHERE 4 * k + 40 > nf AND 4 * k < nf + CASE WHEN {_INC} THEN 4 ELSE 8000 END""")
def hop_windows(spark, sf):
    return round_doubles(windows.hop_windows(fx.timed_episodes(spark, sf), CFG).select("sim_idx", "k", "tau_ms"))


@query("count_windows", f"""{with_views(EPISODES, OVW)}
SELECT CASE WHEN sim_idx % 10 < 7 THEN 'train' WHEN sim_idx % 10 < 8 THEN 'val' ELSE 'test' END AS split,
  count(*) AS windows, count(DISTINCT sim_idx) AS episodes FROM ovw GROUP BY 1""")
def count_windows(spark, sf):
    m = F.pmod("sim_idx", F.lit(10))
    w = windows.overlap_windows(fx.timed_episodes(spark, sf), CFG)
    w = w.withColumn("split", F.when(m < 7, "train").when(m < 8, "val").otherwise("test"))
    return windows.count_windows(w, ["split"], ["sim_idx"])


_LINE = "regexp_matches(target, '^MainLn(\\d+)-(\\d+)[AB]?$') AND location IS NOT NULL"


@query("count_windows_by_class", f"""{with_views(EPISODES, OVW)}, j AS (SELECT o.sim_idx, CASE WHEN sim_idx % 10 < 7 THEN 'train' WHEN sim_idx % 10 < 8 THEN 'val' ELSE 'test' END AS split, {_LINE} AS is_line
  FROM ovw o JOIN eps e USING (sim_idx) WHERE starts_with(e.etype, 'flt_'))
SELECT 'all_faults' AS kind, split, count(*) AS windows, count(DISTINCT sim_idx) AS episodes FROM j GROUP BY 2
UNION ALL SELECT 'line_faults', split, count(*), count(DISTINCT sim_idx) FROM j WHERE is_line GROUP BY 2""")
def count_windows_by_class(spark, sf):
    """Windows and episodes per split, of all faults and of line faults."""
    m = F.pmod("sim_idx", F.lit(10))
    eps = fx.timed_episodes(spark, sf).where(F.col("etype").startswith("flt_"))
    eps = eps.withColumn("split", F.when(m < 7, "train").when(m < 8, "val").otherwise("test"))
    kinds = {"all_faults": eps, "line_faults": episodes.filter_line_faults(eps)}
    parts = [windows.count_windows(windows.overlap_windows(e, CFG), ["split"], ["sim_idx"]).withColumn("kind", F.lit(k)) for k, e in kinds.items()]
    return parts[0].unionByName(parts[1])


@query("window_set_diff", f"""{with_views(EPISODES, EVW, OVW)}
(SELECT sim_idx, win_end, 'left_only' AS side FROM (SELECT DISTINCT sim_idx, win_end FROM evw EXCEPT SELECT sim_idx, win_end FROM ovw))
UNION ALL (SELECT sim_idx, win_end, 'right_only' FROM (SELECT sim_idx, win_end FROM ovw EXCEPT SELECT sim_idx, win_end FROM evw))""")
def window_set_diff(spark, sf):
    eps = fx.timed_episodes(spark, sf)
    return windows.window_set_diff(windows.event_windows(eps, CFG), windows.overlap_windows(eps, CFG), ["sim_idx", "win_end"])


# --- samples in windows ----------------------------------------------------------

@query("assign_samples", f"""{with_views(SIG, EPISODES, EVW)}
SELECT v.sim_idx AS rec, v.win_end, count(*) AS samples, {r('sum(ia * vb)')} AS iv, {r('max(vc)')} AS vmax
FROM evw v JOIN sig s ON s.rec = v.sim_idx AND s.n >= v.win_end - 40 AND s.n < v.win_end GROUP BY 1, 2""")
def assign_samples(spark, sf):
    w = windows.event_windows(fx.episodes(spark, sf), CFG).select(F.col("sim_idx").alias("rec"), "win_end")
    return round_doubles(windows.assign_samples(fx.sig(spark, sf), w, ["rec"], CFG).groupBy("rec", "win_end").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("ia") * F.col("vb")).alias("iv"), F.max("vc").alias("vmax")))


@query("range_moments", f"""{with_views(SIG, EPISODES, EVW)}, g AS (SELECT DISTINCT sim_idx AS rec, win_end AS hi, win_end - 37 AS lo FROM evw
  UNION SELECT sim_idx, win_end, greatest(win_end - 151, 0) FROM evw)
SELECT rec, lo, hi, count(*) AS samples, {r('avg(ia)')} AS mean_ia, {r('var_pop(ia)')} AS var_ia, {r('sum(ia * vb)')} AS iv, {r('regr_slope(ib, (n - hi) / 16.0::DOUBLE)')} AS slope_ib
FROM g JOIN sig s USING (rec) WHERE s.n >= lo AND s.n < hi GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def range_moments(spark, sf):
    """Mean, variance, cross product and slope over ranges of 37 and 151 samples that keep to no hop and no block."""
    w = windows.event_windows(fx.episodes(spark, sf), CFG).select(F.col("sim_idx").alias("rec"), F.col("win_end").alias("hi"))
    c = F.col
    g = w.withColumn("lo", c("hi") - 37).unionByName(w.withColumn("lo", F.greatest(c("hi") - 151, F.lit(0)))).distinct()
    sums = {"a": c("ia"), "aa": c("ia") * c("ia"), "iv": c("ia") * c("vb"), "b": c("ib"), "one": F.lit(1.0)}
    m = moments.range_sums(fx.sig(spark, sf), g, ["rec"], sums, CFG.win, "lo", "hi", {"b": "bt", "one": "t"}, {"one": "tt"}, CFG.cycle)
    n = c("_cnt")
    return round_doubles(m.where(n > 1).select(
        "rec", "lo", "hi", n.alias("samples"), (c("a") / n).alias("mean_ia"), (c("aa") / n - (c("a") / n) * (c("a") / n)).alias("var_ia"), "iv",
        ((c("bt") - c("b") * c("t") / n) / (c("tt") - c("t") * c("t") / n)).alias("slope_ib")))


_PH = [f"{p}_{c}_{x}" for p in "lf" for c in CH for x in ("re", "im")]


@query("window_phasors", f"""{with_views(SIG, ss.LEN, ss.WIN_ENDS, ss.WS, ss.WINDOW_PHASORS)}
SELECT rec, win_end, {', '.join(f'{r(c)} AS {c}' for c in _PH)} FROM wp""")
def window_phasors(spark, sf):
    df = two_ended.window_phasors(fx.sig(spark, sf), ["rec"], CH, CFG, ("last", "first"))
    return round_doubles(df)


@query("phasor_relative", f"""{with_views(SIG, ss.LEN, ss.WIN_ENDS)}
SELECT w.rec, w.win_end, {r('0.125::DOUBLE * sum(ia * cos(2 * pi() * (n - win_end + 16) / 16))')} AS rel_re,
  {r('-0.125::DOUBLE * sum(ia * sin(2 * pi() * (n - win_end + 16) / 16))')} AS rel_im
FROM w JOIN sig s ON s.rec = w.rec AND s.n >= win_end - 16 AND s.n < win_end GROUP BY 1, 2""")
def phasor_relative(spark, sf):
    """Phasor referred to the cycle start: the absolute one, rotated."""
    df = two_ended.window_phasors(fx.sig(spark, sf), ["rec"], ["ia"], CFG)
    return round_doubles(relative_phasor(df, "l_ia", "rel").select("rec", "win_end", "rel_re", "rel_im"))


def relative_phasor(df, name: str, out: str):
    import math
    start = F.pmod(F.col("win_end") - CFG.cycle, F.lit(CFG.cycle))
    return put(df, {out: cx(name).turn(-start * (2 * math.pi / CFG.cycle))})


_SEQ = dict(zip(("i0", "i1", "i2"), q.seq(*[q.var(f"l_i{p}") for p in "abc"])))


@query("sym_components", f"""{with_views(SIG, ss.LEN, ss.WIN_ENDS, ss.WS, ss.WINDOW_PHASORS)}
SELECT rec, win_end, {', '.join(f'{r(v.re)} AS {k}_re, {r(v.im)} AS {k}_im' for k, v in _SEQ.items())} FROM wp""")
def sym_components(spark, sf):
    df = two_ended.window_phasors(fx.sig(spark, sf), ["rec"], signal.CURRENTS, CFG)
    i = [cx(f"l_i{p}") for p in "abc"]
    df = put(df, {"i0": zero_seq(*i), "i1": pos_seq(*i), "i2": neg_seq(*i)})
    return round_doubles(df.select("rec", "win_end", *[f"{k}_{p}" for k in ("i0", "i1", "i2") for p in ("re", "im")]))


@query("reference_cycle", f"""{with_views(SIG, EPISODES)}
SELECT rec, {', '.join(f"{r(f'0.125::DOUBLE * sum({c} * cos(2 * pi() * (n % 16) / 16))')} AS pre_{c}_re, {r(f'-0.125::DOUBLE * sum({c} * sin(2 * pi() * (n % 16) / 16))')} AS pre_{c}_im" for c in CH)}
FROM sig JOIN (SELECT sim_idx AS rec, CAST(floor((event_start - 1.0) * 800) AS INTEGER) - 18 AS pre FROM eps) USING (rec)
WHERE n >= pre AND n < pre + 16 GROUP BY rec""")
def reference_cycle(spark, sf):
    eps = fx.episodes(spark, sf)
    from faultspark.functions.scalar import floor_sample
    starts = eps.select(F.col("sim_idx").alias("rec"),
                        (floor_sample(F.col("event_start"), CFG.t0, CFG.fs) - CFG.memory_gap - CFG.cycle).alias("pre"))
    return round_doubles(windows.reference_cycle(fx.sig(spark, sf), starts, ["rec"], CH, CFG).drop("pre"))


@query("exceed_flags", f"""{with_views(SIG, EPISODES, OVW)}
SELECT v.sim_idx AS rec, v.win_end, CAST(max(abs(ia)) > 0.9::DOUBLE * max(abs(ib)) OR max(abs(va)) > 0.9::DOUBLE * max(abs(ic)) AS INTEGER) AS sat
FROM ovw v JOIN sig s ON s.rec = v.sim_idx AND s.n >= v.win_end - 40 AND s.n < v.win_end GROUP BY 1, 2 HAVING count(*) = 40""")
def exceed_flags(spark, sf):
    w = windows.overlap_windows(fx.timed_episodes(spark, sf), CFG).select(F.col("sim_idx").alias("rec"), "win_end")
    return signal.exceed_flags(fx.sig(spark, sf), w, ["rec"], [("ia", "ib"), ("va", "ic")], CFG, 0.9)


# --- features ----------------------------------------------------------------------

def _feature_select(names, digits=4):
    return ", ".join(f"{r(c, digits)} AS {c}" for c in names)


@query("phasor_features", f"""{with_views(*ss.features_cte(td=False))}
SELECT rec, win_end, {_feature_select(features.PHASOR_FEATURES)} FROM feat""")
def phasor_features(spark, sf):
    df = features.window_features(fx.sig(spark, sf), rec_totals(spark, sf), ["rec"], CFG, group="phasor")
    return round_doubles(df.select("rec", "win_end", *features.PHASOR_FEATURES), 4)


@query("td_features", f"""{with_views(*ss.features_cte(phasor=False))}
SELECT rec, win_end, {_feature_select(features.TD_FEATURES)} FROM feat""")
def td_features(spark, sf):
    df = features.window_features(fx.sig(spark, sf), rec_totals(spark, sf), ["rec"], CFG, group="td")
    return round_doubles(df.select("rec", "win_end", *features.TD_FEATURES), 4)


@query("episode_tokens", f"""{with_views(*ss.features_cte(), EPISODES, OVW)}
SELECT f.rec, f.win_end, {r('v.post_ms')} AS post_ms, {_feature_select(features.FEATURES)}
FROM feat f JOIN ovw v ON v.sim_idx = f.rec AND v.win_end = f.win_end""")
def episode_tokens(spark, sf):
    """All 77 features of the wanted windows of every episode."""
    w = windows.overlap_windows(fx.timed_episodes(spark, sf), CFG).select(F.col("sim_idx").alias("rec"), "win_end", "post_ms")
    feat = features.window_features(fx.sig(spark, sf), rec_totals(spark, sf), ["rec"], CFG, wanted=w)
    df = feat.join(w, ["rec", "win_end"]).select("rec", "win_end", "post_ms", *features.FEATURES)
    return round_doubles(round_cols(df, features.FEATURES, 4))


@query("ohm_tokens", f"""{with_views(*ss.BASE, ss.WINDOW_PHASORS, ss.loop_stage())}
SELECT rec, win_end, {', '.join(f"{r((q.var(f'V{lp}') / q.var(f'I{lp}')).re, 3)} AS {lp}_zr, {r((q.var(f'V{lp}') / q.var(f'I{lp}')).abs(), 3)} AS {lp}_absz" for lp in ss.LOOPS)}
FROM wl""")
def ohm_tokens(spark, sf):
    df = features.ohm_tokens(fx.sig(spark, sf), rec_totals(spark, sf), ["rec"], CFG)
    return round_doubles(df.select("rec", "win_end", *[f"{lp}_{k}" for lp in features.LOOPS for k in ("zr", "absz")]), 3)


@query("unnormalise", f"""{with_views(*ss.features_cte(td=False))}
SELECT rec, win_end, {', '.join(f'{r(f"{lp}_zr * z1r - {lp}_zi * z1x", 4)} AS {lp}_zr, {r(f"{lp}_zr * z1x + {lp}_zi * z1r", 4)} AS {lp}_zi, {r(f"{lp}_absz * sqrt(z1r * z1r + z1x * z1x)", 4)} AS {lp}_absz' for lp in ss.LOOPS)}
FROM feat JOIN lpt USING (rec)""")
def unnormalise(spark, sf):
    df = features.window_features(fx.sig(spark, sf), rec_totals(spark, sf), ["rec"], CFG, group="phasor")
    cols = [f"{lp}_{k}" for lp in features.LOOPS for k in ("zr", "zi", "absz")]
    return round_doubles(features.unnormalise(df).select("rec", "win_end", *cols), 4)


@query("replace_columns", f"""{with_views(*ss.features_cte(td=False))}
SELECT f.rec, f.win_end, {r('f.i2r', 4)} AS i2r, {r((q.var('Vag') / q.var('Iag')).abs(), 3)} AS ag_absz, {r((q.var('Vca') / q.var('Ica')).im, 3)} AS ca_zi
FROM feat f JOIN wl USING (rec, win_end)""")
def replace_columns(spark, sf):
    """Per-unit columns swapped for unclipped ohm values by key."""
    p = rec_totals(spark, sf)
    feat = features.window_features(fx.sig(spark, sf), p, ["rec"], CFG, group="phasor")
    ohm = features.ohm_tokens(fx.sig(spark, sf), p, ["rec"], CFG).select("rec", "win_end", "ag_absz", "ca_zi")
    df = features.replace_columns(feat, ohm, ["rec", "win_end"]).select("rec", "win_end", "i2r", "ag_absz", "ca_zi")
    return round_cols(round_cols(df, ["ag_absz", "ca_zi"], 3), ["i2r"], 4)


# --- two-ended estimates -------------------------------------------------------------

@query("td_estimate", f"{with_views(*ss.td_cte())} SELECT line, win_end, {r('td_est')} AS td_est FROM td")
def td_estimate(spark, sf):
    df = two_ended.td_estimate(fx.two_terminal(spark, sf), line_totals(spark, sf), ["line"], CFG)
    return round_doubles(df.select("line", "win_end", "td_est"))


@query("td_estimate_central", f"{with_views(*ss.td_cte('central'))} SELECT line, win_end, {r('td_est')} AS td_est FROM td")
def td_estimate_central(spark, sf):
    df = two_ended.td_estimate(fx.two_terminal(spark, sf), line_totals(spark, sf), ["line"], CFG, "central")
    return round_doubles(df.select("line", "win_end", "td_est"))


@query("td_scored", f"""{with_views(*ss.td_cte())}
SELECT line, count(*) AS n, {r('avg(e)')} AS mae, {r('max(e)')} AS worst FROM (
  SELECT line, 100 * abs(greatest(0, least(1, td_est)) - (line % 9 + 1) / 10.0::DOUBLE) AS e FROM td) GROUP BY line""")
def td_scored_query(spark, sf):
    return round_doubles(td_scored(spark, sf))


SCALES = [("RLx0.90", 0.9, 0.9), ("RLx0.95", 0.95, 0.95), ("RLx1.05", 1.05, 1.05), ("RLx1.10", 1.1, 1.1),
          ("Rx0.80", 0.8, 1.0), ("Rx1.20", 1.2, 1.0)]
_SC = "sc AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in SCALES) + ") t(scale, kr, kl))"


@query("td_scale_sweep", f"""{with_views(*ss.modal_cte(), _SC)},
uw AS (SELECT line, scale, n, {', '.join(f'''vs_{m} - vr_{m} + z1r * kr * ir_{m} + z1x * kl / {ss.OMEGA} * ir_{m}_d AS u_{m},
  z1r * kr * (is_{m} + ir_{m}) + z1x * kl / {ss.OMEGA} * (is_{m}_d + ir_{m}_d) AS w_{m}''' for m in ('al', 'be'))}
  FROM md JOIN mdd USING (line, n) JOIN lpl USING (line), sc),
lw AS (SELECT line, unnest(range(40, last_n + 2, 4)) AS win_end FROM (SELECT line, max(n) AS last_n FROM md GROUP BY line)),
lwx AS (SELECT line, CAST(win_end AS INTEGER) AS win_end, unnest(range(win_end - 40, win_end)) AS n FROM lw)
SELECT line, win_end, scale, {r('sum(u_al * w_al + u_be * w_be) / (sum(w_al * w_al + w_be * w_be) + 1e-12)', 5)} AS td_est
FROM lwx JOIN uw USING (line, n) GROUP BY line, win_end, scale""")
def td_scale_sweep(spark, sf):
    df = two_ended.td_scale_sweep(fx.two_terminal(spark, sf), line_totals(spark, sf), ["line"], CFG, SCALES)
    return round_doubles(df, 5)


_Y = "(line % 9 + 1) / 10.0::DOUBLE"


@query("scale_sweep_table", f"""{with_views(*ss.modal_cte(), _SC)},
uw AS (SELECT line, scale, n, {', '.join(f'''vs_{m} - vr_{m} + z1r * kr * ir_{m} + z1x * kl / {ss.OMEGA} * ir_{m}_d AS u_{m},
  z1r * kr * (is_{m} + ir_{m}) + z1x * kl / {ss.OMEGA} * (is_{m}_d + ir_{m}_d) AS w_{m}''' for m in ('al', 'be'))}
  FROM md JOIN mdd USING (line, n) JOIN lpl USING (line), sc),
lw AS (SELECT line, unnest(range(40, last_n + 2, 4)) AS win_end FROM (SELECT line, max(n) AS last_n FROM md GROUP BY line)),
lwx AS (SELECT line, CAST(win_end AS INTEGER) AS win_end, unnest(range(win_end - 40, win_end)) AS n FROM lw),
e AS (SELECT line, win_end, scale, sum(u_al * w_al + u_be * w_be) / (sum(w_al * w_al + w_be * w_be) + 1e-12) AS est FROM lwx JOIN uw USING (line, n) GROUP BY line, win_end, scale)
SELECT scale AS method, count(*) AS n, {r(f'100 * avg(abs(greatest(0, least(1, est)) - {_Y}))', 4)} AS mae FROM e GROUP BY scale""")
def scale_sweep_table(spark, sf):
    """Scaled parameters to windows to scores: one row per scale."""
    df = two_ended.td_scale_sweep(fx.two_terminal(spark, sf), line_totals(spark, sf), ["line"], CFG, SCALES)
    wide = df.groupBy("line", "win_end").pivot("scale", [n for n, _, _ in SCALES]).agg(F.first("td_est"))
    wide = wide.withColumn("y", (F.pmod("line", F.lit(9)) + 1) / 10.0)
    return round_doubles(report.sweep_table(wide, [], [f"`{n}`" for n, _, _ in SCALES]), 4)


SHIFTS = (-1, 1, 20)


def _sync_sql() -> str:
    """Each shift as a statement of its own: the remote record is read k samples late, around its end."""
    parts = []
    for k in SHIFTS:
        views = [v.replace("JOIN sig b ON b.rec = a.rec + 1 AND b.n = a.n", f"JOIN sb b ON b.rec = a.rec + 1 AND b.n = a.n") for v in ss.td_cte()]
        sb = f"sb AS (SELECT s.* EXCLUDE (n), CAST((s.n + {k} + size) % size AS INTEGER) AS n FROM sig s JOIN (SELECT rec, max(n) + 1 AS size FROM sig GROUP BY rec) USING (rec))"
        body = with_views(views[0], sb, *views[1:])
        parts.append(f"SELECT * FROM ({body} SELECT 'shift {k:+d}' AS method, count(*) AS n, {r(f'100 * avg(abs(greatest(0, least(1, td_est)) - {_Y}))', 4)} AS mae FROM td)")
    return " UNION ALL ".join(parts)


@query("sync_sweep", _sync_sql())
def sync_sweep(spark, sf):
    """Remote samples shifted, estimates made again and scored: one row per shift."""
    s, p = fx.two_terminal(spark, sf, fx.stored_sig(spark, sf)), line_totals(spark, sf)
    near, far = s.where("term = 0"), s.where("term = 1")
    wide = None
    for k in SHIFTS:
        moved = near.unionByName(signal.shift_record(far, ["line"], k))
        est = two_ended.td_estimate(moved, p, ["line"], CFG).select("line", "win_end", F.col("td_est").alias(f"shift {k:+d}"))
        wide = est if wide is None else wide.join(est, ["line", "win_end"])
    wide = wide.withColumn("y", (F.pmod("line", F.lit(9)) + 1) / 10.0)
    return round_doubles(report.sweep_table(wide, [], [f"`shift {k:+d}`" for k in SHIFTS]), 4)


_TWO = f"""tp AS (SELECT a.rec // 2 AS line, a.win_end,
  {', '.join(f'a.l_{c}_{x} AS s_{c}_{x}, b.l_{c}_{x} AS r_{c}_{x}' for c in CH for x in ('re', 'im'))}
  FROM wp a JOIN wp b ON b.rec = a.rec + 1 AND b.win_end = a.win_end WHERE a.rec % 2 = 0)"""
LPL = "lpl AS (SELECT rec // 2 AS line, * EXCLUDE (rec) FROM lpt WHERE rec % 2 = 0)"
_P = {f"{k}{t}": q.seq(*[q.var(f"{t}_{k}{p}") for p in "abc"])[1] for k in "iv" for t in "sr"}
_Z = q.S("z1r", "z1x")
_NUM = _P["vs"] - _P["vr"] + _Z * _P["ir"]
_DEN = _Z * (_P["is"] + _P["ir"])


@query("phasor_estimate", f"""{with_views(*ss.BASE, ss.WINDOW_PHASORS, _TWO, LPL)}
SELECT line, win_end, CASE WHEN {_DEN.abs()} > 1e-9 THEN {r((_NUM / _DEN).re, 5)} END AS ph_est FROM tp JOIN lpl USING (line)""")
def phasor_estimate(spark, sf):
    df = two_ended.phasor_estimate(fx.two_terminal(spark, sf), line_totals(spark, sf), ["line"], CFG)
    return round_doubles(df, 5)
