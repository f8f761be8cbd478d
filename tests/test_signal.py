import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultspark.config import COMPACT, SignalConfig
from faultspark.functions.cplx import cx
from faultspark.operators import features, lines, locate, signal, two_ended, windows
from faultspark.operators.blocks import halo_blocks, owned_samples
from faultspark.plans import fixtures as fx

CFG = SignalConfig(fs=800.0, win=40, hop=4, active_len=24, memory_gap=2, block_hops=16)
LONG = SignalConfig(fs=800.0, win=40, hop=4, active_len=24, memory_gap=2, block_hops=1000)


def sinusoid(spark, n=200, amp=2.5, phase=0.7):
    x = F.lit(amp) * F.cos(F.col("id") * (2 * math.pi / 16) + phase)
    return spark.range(n).select(F.lit(1).alias("rec"), F.col("id").cast("int").alias("n"), x.alias("ia"))


def test_phasor_of_sinusoid(spark):
    rows = two_ended.window_phasors(sinusoid(spark), ["rec"], ["ia"], CFG, ("last", "first")).collect()
    assert len(rows) == (200 - 40) // 4 + 1
    want = 2.5 * complex(math.cos(0.7), math.sin(0.7))
    for r in rows:
        assert abs(complex(r.l_ia_re, r.l_ia_im) - want) < 1e-9
        assert abs(complex(r.f_ia_re, r.f_ia_im) - want) < 1e-9


@pytest.mark.parametrize("size", [11, 12, 37, 64, 65, 69, 130])
def test_quadratic_derivative_with_edges(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=size)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "rec int, n int, ia double")
    out = owned_samples(signal.deriv_quadratic(halo_blocks(df, CFG), ["ia"], ["rec", "blk"], CFG), CFG)
    got = {r.n: r.ia_d for r in out.collect()}
    k = np.arange(-5, 6)
    for n in range(size):
        c = min(max(n, 5), size - 6)
        p = np.polyfit(k, x[c - 5:c + 6], 2)
        want = (2 * p[0] * (n - c) + p[1]) * 800.0
        assert got[n] == pytest.approx(want, abs=1e-7)


def test_gap_makes_derivative_undefined_and_drops_windows(spark):
    df = sinusoid(spark).where(F.col("n") != 100)
    out = owned_samples(signal.deriv_quadratic(halo_blocks(df, CFG), ["ia"], ["rec", "blk"], CFG), CFG)
    null = sorted(r.n for r in out.where(F.col("ia_d").isNull()).collect())
    assert null == [n for n in range(95, 106) if n != 100]
    ends = {r.win_end for r in two_ended.window_phasors(df, ["rec"], ["ia"], CFG).collect()}
    assert ends == {e for e in range(40, 201, 4) if not e - 40 <= 100 < e}


def two_source_line(spark, d, n=400, z=(0.4, 3.0)):
    """Steady state of a line with a fault at share d, both ends measured."""
    zc = complex(*z)
    el = {0: complex(100, 5), 1: complex(92, -11)}
    zs = {0: complex(0.2, 4.0), 1: complex(0.3, 5.5)}
    rf = 2.0
    a = np.exp(2j * np.pi / 3)
    ya, yb = 1 / (zs[0] + d * zc), 1 / (zs[1] + (1 - d) * zc)
    vf = (el[0] * ya + el[1] * yb) / (ya + yb + 1 / rf)
    i = {0: (el[0] - vf) * ya, 1: (el[1] - vf) * yb}
    v = {t: el[t] - zs[t] * i[t] for t in (0, 1)}
    rows = []
    for t in (0, 1):
        for k in range(n):
            w = np.exp(2j * np.pi * k / 16)
            vals = [float((q[t] * rot * w).real) for q in (i, v) for rot in (1, a * a, a)]
            rows.append((1, t, k, *vals))
    s = spark.createDataFrame(rows, "line int, term int, n int, ia double, ib double, ic double, va double, vb double, vc double")
    p = spark.createDataFrame([(1, 1.0, z[0], z[1], 3 * z[0], 3 * z[1])], "line int, length_km double, z1r double, z1x double, z0r double, z0x double")
    return s, p


def test_two_ended_estimates_recover_location(spark):
    s, p = two_source_line(spark, 0.3)
    ph = two_ended.phasor_estimate(s, p, ["line"], CFG).agg(F.min("ph_est"), F.max("ph_est")).first()
    assert ph[0] == pytest.approx(0.3, abs=1e-9) and ph[1] == pytest.approx(0.3, abs=1e-9)
    td = two_ended.td_estimate(s, p, ["line"], CFG, "central").agg(F.avg("td_est")).first()[0]
    assert td == pytest.approx(0.3, abs=0.05)
    sweep = two_ended.td_scale_sweep(s, p, ["line"], CFG, [("same", 1.0, 1.0)])
    both = two_ended.td_estimate(s, p, ["line"], CFG).join(sweep.withColumnRenamed("td_est", "b"), ["line", "win_end"])
    assert both.agg(F.max(F.abs(F.col("td_est") - F.col("b")))).first()[0] < 1e-9


def test_staged_locator_matches_phasor_when_late(spark):
    s, p = two_source_line(spark, 0.7)
    w = spark.createDataFrame([(1, 100, e, (e - 100) / 0.8) for e in (100, 108, 112, 140, 200)], "line int, nf int, win_end int, tau_ms double")
    got = {r.win_end: r.est for r in locate.staged_locator(s, w, p, ["line"], CFG).collect()}
    assert got[100] == 0.5
    assert all(got[e] == pytest.approx(0.7, abs=1e-6) for e in (108, 112, 140, 200))


def test_conditioning_identity(spark):
    """Observed and predicted one-ended error agree for an exact circuit."""
    s, p = two_source_line(spark, 0.4)
    quiet = s.where(F.col("n") < 100).withColumns({c: F.col(c) * 0.0 for c in ("ia", "ib", "ic")})
    s = quiet.unionByName(s.where(F.col("n") >= 100))
    p = p.withColumns({"z0r": F.col("z1r"), "z0x": F.col("z1x")})
    w = spark.createDataFrame([(1, e, 100, 50.0, "flt_1phg_shc", "ag", 2.0, 0.4) for e in (160, 200)],
                              "line int, win_end int, nf int, post_ms double, etype string, loop string, r_f double, y double")
    rows = locate.conditioning(s, w, p, ["line"], CFG).collect()
    assert len(rows) == 2
    for r in rows:
        assert r.e_obs_R == pytest.approx(r.e_pred_R, abs=1e-9)
        assert r.e_obs_T == pytest.approx(r.e_pred_T, abs=1e-9)


def test_blocks_do_not_change_results(spark, sf):
    s, p = fx.two_terminal(spark, sf), lines.totals(fx.line_params(spark, sf, "line"))
    a = two_ended.td_estimate(s, p, ["line"], CFG).select("line", "win_end", F.col("td_est").alias("a"))
    b = two_ended.td_estimate(s, p, ["line"], LONG).select("line", "win_end", F.col("td_est").alias("b"))
    j = a.join(b, ["line", "win_end"], "full_outer").agg(
        F.count(F.lit(1)), F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("int")), F.max(F.abs(F.col("a") - F.col("b")))).first()
    assert j[0] > 500 and j[1] == 0 and j[2] < 1e-9


def test_feature_names_and_leak_guard():
    assert len(features.FEATURES) == 77 and len(features.PHASOR_FEATURES) == 59
    features.check_allow(features.FEATURES)
    for bad in (["y"], ["R"], ["line"], ["phys_react_oracle"], ["tau_ms"], ["ag_zr", "ag_zr"], ["sim_idx"]):
        with pytest.raises(ValueError):
            features.check_allow(bad)


def test_rank_deficient_fit_takes_minimum_norm(spark):
    """With g a multiple of u the fit equals numpy's least-norm solution."""
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=24), rng.normal(size=24)
    g = 2.0 * u
    sums = {}
    for lp in features.LOOPS:
        for name, x in (("vv", v @ v), ("uu", u @ u), ("gg", g @ g), ("vu", v @ u), ("vg", v @ g), ("ug", u @ g)):
            sums[f"{name}_{lp}"] = float(x)
    df = features.td_features(spark.createDataFrame([tuple(sums.values())], list(sums)))
    beta = np.linalg.lstsq(np.stack([u, g], 1), v, rcond=None)[0]
    assert df.first().ag_dtd == pytest.approx(beta[0], abs=1e-9)


def test_noise_level_and_determinism(spark):
    s = sinusoid(spark, 4000)
    a = signal.add_noise(s, ["rec"], ["ia"], 20.0, 3, CFG)
    b = signal.add_noise(s.repartition(7, "n"), ["rec"], ["ia"], 20.0, 3, CFG)
    j = s.join(a.withColumnRenamed("ia", "a"), ["rec", "n"]).join(b.withColumnRenamed("ia", "b"), ["rec", "n"])
    sd, gap, rms = j.agg(F.stddev(F.col("a") - F.col("ia")), F.max(F.abs(F.col("a") - F.col("b"))), F.sqrt(F.avg(F.col("ia") ** 2))).first()
    assert gap < 1e-12
    assert sd == pytest.approx(rms / 10, rel=0.05)


def test_window_counts(spark):
    """16 windows per short circuit and 10 per 5 ms transient at full rate."""
    cfg = SignalConfig()
    eps = spark.createDataFrame([(1, "flt_3ph_shc", 1.1, None), (2, "flt_1phg_incipient", 1.1, 0.005)],
                                "sim_idx long, etype string, event_start double, duration double")
    eps = eps.withColumn("n_samples", F.lit(4801))
    n = {r.sim_idx: r["count"] for r in windows.overlap_windows(eps, cfg).groupBy("sim_idx").count().collect()}
    ends = {r.sim_idx: r["count"] for r in windows.event_windows(eps, cfg).groupBy("sim_idx").count().collect()}
    assert n == {1: 16, 2: 10}
    assert ends == {1: 16, 2: 10}


def test_one_shuffle_for_all_sample_work(spark, sf):
    df = two_ended.td_estimate(fx.two_terminal(spark, sf), lines.totals(fx.line_params(spark, sf, "line")), ["line"], COMPACT)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sum("hashpartitioning(line" in ln and "blk" in ln for ln in plan.splitlines()) == 1


def test_window_arrays_stay_where_they_are_made(spark, sf):
    ends = spark.createDataFrame([(1, 40, 7), (1, 44, 8), (1, 44, 9), (3, 38, 7), (None, 40, 7)], "rec bigint, win_end int, k int")
    s, pair, p = fx.sig(spark, sf), fx.two_terminal(spark, sf), lines.totals(fx.line_params(spark, sf, "line"))
    joins = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = windows.raw_windows(s, ends, ["rec"], ["ia", "vc"], COMPACT)
        both = two_ended.raw_windows(pair, p, ends.withColumnRenamed("rec", "line"), ["line"], COMPACT)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, both)]
        rows = {(r.win_end, r.k): r for r in found.collect()}
    finally:
        for k, v in joins.items():
            spark.conf.set(k, v)
    for plan in plans:  # nothing is dealt by window
        assert not [ln for ln in plan.splitlines() if "hashpartitioning" in ln and "win_end" in ln]
    assert sorted(rows) == [(40, 7), (44, 8), (44, 9)]
    ia = np.array([r.ia for r in s.where("rec = 1 and n < 44").orderBy("n").collect()], np.float32)
    for (end, _), r in rows.items():
        assert np.array_equal(np.array(r.ia, np.float32), ia[end - 40:end])


def test_complex_division_by_zero_is_undefined(spark):
    r = spark.sql("select 1D a_re, 2D a_im, 0D b_re, 0D b_im").select((cx("a") / cx("b")).re.alias("x")).first()
    assert r.x is None


def test_fast_draws(spark):
    """Moments, ranges, no link between neighbouring keys, the same draw in any partition."""
    from faultspark.functions import draws

    df = spark.range(40000).select("id", draws.fast_uniform(5, F.col("id"), "ia").alias("u"), draws.fast_normal(5, F.col("id"), "ia").alias("z"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev_pop("z"), F.kurtosis("z")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 < r[1] < r[2] < 1 and abs(r[3]) < 0.02 and abs(r[4] - 1) < 0.02 and abs(r[5]) < 0.1
    lag = df.alias("a").join(df.alias("b"), F.col("a.id") + 1 == F.col("b.id")).agg(F.corr("a.z", "b.z")).first()[0]
    assert abs(lag) < 0.02
    again = spark.range(40000).repartition(9).select("id", draws.fast_normal(5, F.col("id"), "ia").alias("w"))
    assert df.join(again, "id").where("z <> w").count() == 0


def test_episode_without_whole_cycle_is_null(spark):
    """One episode inside the record, one whose fault cycle runs past its end, one of an unknown line."""
    s, p = two_source_line(spark, 0.3)
    last = s.agg(F.max("n")).first()[0]
    eps = spark.createDataFrame([(1, 100), (1, last - 5), (9, 100)], "line int, nf int")
    rows = two_ended.fault_cycles(s, eps, ["line"], ["ia"], CFG, {"p": -2 * CFG.cycle, "f": CFG.cycle}).collect()
    got = {(r.line, r.nf): (r.s_p_ia_re is not None, r.r_f_ia_im is not None) for r in rows}
    assert got == {(1, 100): (True, True), (1, last - 5): (True, False), (9, 100): (False, False)}
    assert two_ended.episode_locator(s, eps, ["line"], CFG).where("d is null").count() == 2


def test_wide_rows_are_rounded_together(spark):
    """The same in every bit as Spark's round, ties, large and undefined values included, with one rounding expression a row."""
    import random

    from faultspark.plans import registry

    rng = random.Random(3)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e300, 123456789.12345, -98765432109.87655]
    xs = odd + [k / 20000.0 for k in range(-2001, 2001)] + [rng.gauss(0, 10.0 ** rng.randint(-6, 7)) for _ in range(3000)]
    xs += [round(rng.uniform(-1000, 1000), 4) + 0.00005 for _ in range(1000)]
    wide = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[(F.col("x") * (1 if i == 0 else i)).alias(f"c{i}") for i in range(20)])
    names = [f"c{i}" for i in range(20)]
    got = registry.round_cols(wide, names, 4)
    assert got.columns == wide.columns
    want = wide.withColumns({n: F.round(n, 4) + 0.0 for n in names})
    bits = lambda df: sorted(map(repr, df.collect()))
    assert bits(got) == bits(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("round(") <= 2


def test_phasor_windows_copy_no_samples(spark):
    """Samples are summed by pane before anything is copied to blocks."""
    line = spark.createDataFrame([(1, 0.1, 0.3, 0.2, 0.9)], "rec int, z1r double, z1x double, z0r double, z0x double")
    samples = sinusoid(spark)
    for x in features.signal.CHANNELS:
        samples = samples if x in samples.columns else samples.withColumn(x, samples["ia"])
    plan = features.window_sums(samples, line, ["rec"], CFG, td=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")  # the copying stands above the sums
