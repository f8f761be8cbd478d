"""Queries on per-window estimate tables: scores, bins, reports, joins, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultspark.functions import scalar
from faultspark.functions.cplx import Cx
from faultspark.operators import joins, lines, numbering, quality, report, resample, two_ended, windows
from faultspark.operators.features import guard_small
from faultspark.operators.locate import orientation_check, switch_rule
from faultspark.plans import fixtures as fx
from faultspark.plans.registry import query, round_cols, round_doubles
from faultspark.plans.sqlviews import PRED, err, r, with_views
from faultspark.sources import buckets
from faultspark.sources.stage import shared_path

E_EST, E_EST2 = err("est"), err("est2")
SC = "NOT regexp_matches(etype, 'incipient|hif')"
NOT_INC = "NOT contains(etype, 'incipient')"
c = F.col


def pred(spark, sf):
    return fx.predictions(spark, sf)


def scored(spark, sf):
    return pred(spark, sf).withColumns({"e": scalar.score(c("est"), c("y")), "e2": scalar.score(c("est2"), c("y"))})


SCORED = f"sc AS (SELECT *, {E_EST} AS e, {E_EST2} AS e2 FROM pred)"
METHODS = {"R": "est", "T": "est2"}
LONG = f"""lg AS (SELECT grid, sim_idx, win, post_ms, etype, y, rho, r_f, 'R' AS method, est AS est FROM pred
  UNION ALL SELECT grid, sim_idx, win, post_ms, etype, y, rho, r_f, 'T', est2 FROM pred)"""


# --- scores and reports ---------------------------------------------------------

@query("score", f"""{with_views(PRED, SCORED)} SELECT grid, sim_idx, win, {r('e')} AS e, {r('e2')} AS e2,
  {r('CASE WHEN est IS NOT NULL THEN 100 * abs(greatest(0, least(1, est)) - y) * length_km * 10 END')} AS metres_defined FROM sc""")
def score(spark, sf):
    d = scored(spark, sf)
    m = scalar.to_metres(scalar.score_defined(c("est"), c("y")), c("length_km"))
    return round_doubles(d.select("grid", "sim_idx", "win", "e", "e2", m.alias("metres_defined")))


@query("summary", f"""{with_views(PRED, SCORED)}
SELECT grid, count(*) AS n, count(DISTINCT sim_idx) AS episodes, {r('avg(e)')} AS mae, {r('avg(e) FILTER (post_ms <= 15)')} AS mae_le15,
 {r('avg(e) FILTER (post_ms >= 21)')} AS mae_ge21, {r(f'avg(e) FILTER ({NOT_INC})')} AS mae_non_incipient, {r('quantile_cont(e, 0.5)')} AS median FROM sc GROUP BY grid""")
def summary(spark, sf):
    return round_doubles(report.summary(scored(spark, sf), ["grid"]))


_BINS = ", ".join(f"{r(f'avg(e) FILTER (post_ms > {a} AND post_ms <= {b})')} AS \"post {lab}\"" for a, b, lab in
                  (("0", "17.5", "<=15"), ("17.5", "32.5", "20-30"), ("32.5", "52.5", "35-50"), ("52.5", "1e9", ">=55")))


@query("time_bin_report", f"""{with_views(PRED, LONG)}
SELECT grid, method, count(*) AS n, sum(CAST(est IS NULL AS INTEGER)) AS n_undefined, {r('avg(e)')} AS mae, {r(f'avg(e) FILTER ({SC})')} AS mae_sc, {_BINS},
 {r('quantile_cont(e, 0.5)')} AS median FROM (SELECT *, {E_EST} AS e FROM lg) GROUP BY grid, method""")
def time_bin_report(spark, sf):
    return round_doubles(report.time_bin_report(pred(spark, sf), ["grid"], METHODS))


def _case_bins(x, edges, closed):
    lo, hi = (">", "<=") if closed == "right" else (">=", "<")
    lab = (lambda a, b: f"({a}, {b}]") if closed == "right" else (lambda a, b: f"[{a}, {b})")
    return "CASE " + " ".join(f"WHEN {x} {lo} {a} AND {x} {hi} {b} THEN '{lab(a, b)}'" for a, b in zip(edges, edges[1:])) + " END"


@query("bin_tau", f"""{with_views(PRED, SCORED)}, b AS (SELECT grid, {_case_bins('post_ms * 0.7', report.TAU_EDGES, 'left')} AS bin, e FROM sc)
SELECT grid, bin, count(*) AS n, {r('avg(e)')} AS mean, {r('quantile_cont(e, 0.5)')} AS median FROM b WHERE bin IS NOT NULL GROUP BY grid, bin""")
def bin_tau(spark, sf):
    """Times are scaled so that values fall off the 5 ms grid."""
    return round_doubles(report.binned(scored(spark, sf), ["grid"], report.bin_tau(c("post_ms") * 0.7)))


@query("bin_resistance", f"""{with_views(PRED, SCORED)}
SELECT grid, CASE WHEN r_f <= 1 THEN '<=1' WHEN r_f <= 10 THEN '1-10' WHEN r_f <= 25 THEN '10-25' ELSE '>25' END AS bin,
 count(*) AS n, {r('avg(e)')} AS mean, {r('quantile_cont(e, 0.5)')} AS median FROM sc GROUP BY 1, 2""")
def bin_resistance(spark, sf):
    return round_doubles(report.binned(scored(spark, sf), ["grid"], report.bin_resistance(c("r_f"))))


_TB = ("CASE WHEN {x} > 0 AND {x} <= 17.5 THEN '<=15' WHEN {x} <= 32.5 THEN '20-30' WHEN {x} <= 52.5 THEN '35-50' ELSE '>=55' END",
       "CASE WHEN {x} <= 15 THEN '<=15' WHEN {x} <= 30 THEN '20-30' WHEN {x} <= 50 THEN '35-50' ELSE '>=55' END")


@query("bin_conventions", f"""{with_views(PRED)}
SELECT {_TB[0].format(x='(post_ms + 1.25)')} AS by_edges, {_TB[1].format(x='(post_ms + 1.25)')} AS by_ladder, count(*) AS n FROM pred GROUP BY 1, 2""")
def bin_conventions(spark, sf):
    """Two bin conventions agree on the 5 ms grid and differ off it."""
    x = c("post_ms") + 1.25
    return (pred(spark, sf).select(report.bin_time(x).alias("by_edges"), report.bin_time_ladder(x).alias("by_ladder"))
            .groupBy("by_edges", "by_ladder").agg(F.count(F.lit(1)).alias("n")))


for _closed in ("right", "left"):
    @query(f"rho_bins_{_closed}", f"""{with_views(PRED, LONG)}
SELECT grid, method, rho_bin, count(*) AS n, {r(f'avg({E_EST})')} AS mae FROM (
  SELECT *, {_case_bins('rho', report.RHO_EDGES, _closed)} AS rho_bin FROM lg WHERE method != 'R' OR est IS NOT NULL)
WHERE rho_bin IS NOT NULL GROUP BY grid, method, rho_bin""")
    def rho_bins(spark, sf, closed=_closed):
        return round_doubles(report.rho_bins(pred(spark, sf), ["grid"], METHODS, ["R"], closed=closed))


@query("group_by_type", f"""{with_views(PRED, SCORED)}
SELECT grid, replace(etype, 'flt_', '') AS kind, count(*) AS n, {r('avg(e)')} AS mean, {r('quantile_cont(e, 0.5)')} AS median,
 {r('quantile_cont(e, 0.25)')} AS q25, {r('quantile_cont(e, 0.75)')} AS q75, {r('quantile_cont(e, 0.9)')} AS p90, {r('quantile_cont(e, 0.95)')} AS p95
FROM sc GROUP BY 1, 2""")
def group_by_type(spark, sf):
    d = scored(spark, sf).withColumn("kind", scalar.strip_prefix(c("etype")))
    keys = ["grid", "kind"]
    agg = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"))
    probs = {"median": 0.5, "q25": 0.25, "q75": 0.75, "p90": 0.9, "p95": 0.95}
    return round_doubles(report.with_quantiles(agg, d, keys, "e", probs))


@query("group_by_line", f"""{with_views(PRED, SCORED)} SELECT line, count(*) AS n, {r('avg(e)')} AS mean, {r('quantile_cont(e, 0.5)')} AS median FROM sc GROUP BY line""")
def group_by_line(spark, sf):
    d = scored(spark, sf)
    agg = d.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"))
    return round_doubles(report.with_quantiles(agg, d, ["line"], "e", {"median": 0.5}))


@query("error_ecdf", f"""{with_views(PRED)}, sc AS (SELECT grid, round({E_EST}, 6) + 0.0 AS e FROM pred)
SELECT grid, e, count(*) AS n_at, {r('max(cd)')} AS ecdf FROM (SELECT grid, e, cume_dist() OVER (PARTITION BY grid ORDER BY e) AS cd FROM sc) GROUP BY grid, e""")
def error_ecdf(spark, sf):
    d = round_cols(scored(spark, sf), ["e"]).select("grid", "e")
    return round_cols(numbering.ecdf(d, ["grid"], "e"), ["ecdf"])


@query("per_time_curve", f"""{with_views(PRED, SCORED)}
SELECT grid, CASE WHEN grouping(t) = 1 THEN 'all' ELSE CAST(t AS VARCHAR) END AS t, count(*) AS n, {r('avg(e)')} AS e, {r('avg(e2)')} AS e2
FROM (SELECT *, CAST(round_even(post_ms * 0.9::DOUBLE, 0) AS INTEGER) AS t FROM sc) GROUP BY GROUPING SETS ((grid, t), (grid))""")
def per_time_curve(spark, sf):
    d = scored(spark, sf).withColumn("p", c("post_ms") * 0.9)
    return round_doubles(report.per_time_curve(d, "grid", "p", ["e", "e2"]))


@query("pivot_report", f"""{with_views(PRED, SCORED)}
SELECT etype, {r("avg(e) FILTER (grid = 'O')")} AS "O", {r("avg(e) FILTER (grid = 'F')")} AS "F" FROM sc GROUP BY etype""")
def pivot_report(spark, sf):
    return round_doubles(report.pivot_report(scored(spark, sf), ["etype"], "grid", ["O", "F"], "e"))


@query("tidy_metrics", f"""{with_views(PRED, SCORED)}, s AS (SELECT grid, etype, avg(e) AS mae, avg(e2) AS mae2, avg(e) FILTER (post_ms > 34) AS late FROM sc GROUP BY 1, 2)
SELECT grid, etype, stat, {r('value')} AS value FROM (UNPIVOT s ON mae, mae2, late INTO NAME stat VALUE value)""")
def tidy_metrics(spark, sf):
    s = scored(spark, sf).groupBy("grid", "etype").agg(
        F.avg("e").alias("mae"), F.avg("e2").alias("mae2"), report.mean_where(c("e"), c("post_ms") > 34).alias("late"))
    return round_doubles(report.tidy(s, ["grid", "etype"], ["mae", "mae2", "late"]))


SEEDS = """sd AS (SELECT grid, sim_idx, win, y, seed, coalesce(est, 0.5) * (1 - 0.1::DOUBLE * seed) + 0.02::DOUBLE * seed AS pred
 FROM pred, (VALUES (0), (1), (2)) t(seed))"""


def seeded(spark, sf):
    p = pred(spark, sf).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seed"))
    return p.withColumn("pred", F.coalesce("est", F.lit(0.5)) * (F.lit(1.0) - c("seed") * 0.1) + c("seed") * 0.02)


@query("seed_spread", f"""{with_views(PRED, SEEDS)}
SELECT grid, count(*) AS seeds, {r('avg(m)')} AS mean, {r('stddev_samp(m)')} AS std FROM (SELECT grid, seed, avg({err('pred')}) AS m FROM sd GROUP BY 1, 2) GROUP BY grid""")
def seed_spread(spark, sf):
    d = seeded(spark, sf).withColumn("e", scalar.score(c("pred"), c("y")))
    return round_doubles(report.seed_spread(d, ["grid"]))


@query("seed_ensemble", f"""{with_views(PRED, SEEDS)}, w AS (SELECT grid, sim_idx, win, any_value(y) AS y, avg(pred) AS p, avg({err('pred')}) AS es FROM sd GROUP BY 1, 2, 3)
SELECT grid, count(*) AS n, {r(f"avg({err('p')})")} AS e_ensemble, {r('avg(es)')} AS e_mean_of_seeds FROM w GROUP BY grid""")
def seed_ensemble(spark, sf):
    w = report.seed_ensemble(seeded(spark, sf), ["grid", "sim_idx", "win"])
    return round_doubles(w.groupBy("grid").agg(F.count(F.lit(1)).alias("n"), F.avg("e_ensemble").alias("e_ensemble"),
                                               F.avg("e_mean_of_seeds").alias("e_mean_of_seeds")))


def _cov(nm, m):
    return (f"{r(f'avg(e) FILTER ({m} AND est IS NOT NULL)')} AS mae_{nm}, {r(f'100 * avg(CAST(est IS NOT NULL AS INTEGER)) FILTER ({m})')} AS coverage_{nm}, "
            f"{r(f'100 * avg(CAST(est IS NOT NULL AS INTEGER)) FILTER ({m} AND line % 4 != 3)')} AS coverage_possible_{nm}")


@query("coverage", f"""{with_views(PRED, SCORED)}
SELECT grid, {_cov('all', 'true')}, {_cov('le15', 'post_ms <= 15.000001')}, {_cov('ge20', 'post_ms >= 19.999999')} FROM sc GROUP BY grid""")
def coverage(spark, sf):
    return round_doubles(report.coverage(pred(spark, sf), ["grid"], "est", can=F.pmod("line", F.lit(4)) != 3))


_NEAR = "abs(greatest(0, least(1, coalesce(est, 0.5))) - 0.5) <= 0.02"


@query("middle_shares", f"""{with_views(PRED)}
SELECT grid, {r('avg(CAST(abs(y - 0.5) < 1e-9 AS INTEGER))')} AS share_mid, {r(f'avg(CAST({_NEAR} AS INTEGER))')} AS share_near_mid,
 {r(f'avg(CAST({_NEAR} AS INTEGER)) FILTER (abs(y - 0.5) < 1e-9)')} AS share_near_given_mid FROM pred GROUP BY grid""")
def middle_shares(spark, sf):
    return round_doubles(report.middle_shares(pred(spark, sf), ["grid"], "est"))


@query("exclude_constant_label", f"""{with_views(PRED, SCORED)} SELECT grid, count(*) AS n, {r('avg(e)')} AS mae FROM sc WHERE abs(y - 0.5) >= 1e-9 GROUP BY grid""")
def exclude_constant_label(spark, sf):
    d = report.exclude_constant_label(scored(spark, sf))
    return round_doubles(d.groupBy("grid").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae")))


@query("prefault_cost", f"""{with_views(PRED, SCORED)}
SELECT grid, {r('avg(e) FILTER (post_ms * 4 <= 50)')} AS with_prefault, {r('avg(e) FILTER (post_ms * 4 > 52.5)')} AS post_only FROM sc GROUP BY grid""")
def prefault_cost(spark, sf):
    return round_doubles(report.prefault_cost(scored(spark, sf).withColumn("post_ms", c("post_ms") * 4), ["grid"]))


_SCN = "CASE line % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'filtered' ELSE 'noisy' END"


@query("scenario_table", f"""{with_views(PRED, SCORED)}, d AS (SELECT *, {_SCN} AS scenario, CAST(length_km > 40 AS INTEGER) AS sat FROM sc)
SELECT grid, scenario, count(*) AS n, {r('100 * avg(CAST(sat = 1 AS INTEGER))')} AS flagged_pct,
 {', '.join(f"{r(f'avg({k})')} AS {n}, {r(f'avg({k}) FILTER (sat = 1)')} AS {n}_flagged, {r(f'avg({k}) FILTER (post_ms <= 15)')} AS {n}_le15, {r(f'avg({k}) FILTER (post_ms >= 21)')} AS {n}_ge21" for n, k in (('two_ended', 'e2'), ('learned', 'e')))}
FROM d GROUP BY 1, 2""")
def scenario_table(spark, sf):
    k = F.pmod("line", F.lit(3))
    d = scored(spark, sf).withColumns({"scenario": F.when(k == 0, "clean").when(k == 1, "filtered").otherwise("noisy"),
                                       "sat": (c("length_km") > 40).cast("int")})
    return round_doubles(report.scenario_table(d, ["grid", "scenario"], {"two_ended": "e2", "learned": "e"}))


@query("sweep_table", f"""{with_views(PRED)}, d AS (SELECT grid, y, est2 AS base, est2 * 1.05::DOUBLE AS up, est2 - 0.03::DOUBLE AS shifted FROM pred),
u AS (UNPIVOT d ON base, up, shifted INTO NAME method VALUE est) SELECT grid, method, count(*) AS n, {r(f'avg({E_EST})')} AS mae FROM u GROUP BY grid, method""")
def sweep_table(spark, sf):
    d = pred(spark, sf).withColumns({"base": c("est2"), "up": c("est2") * 1.05, "shifted": c("est2") - 0.03})
    return round_doubles(report.sweep_table(d, ["grid"], ["base", "up", "shifted"]))


@query("grid_facts", f"""{with_views(PRED)}, d AS (SELECT *, 1.0::DOUBLE + (line % 7) * 0.5::DOUBLE AS len FROM pred)
SELECT grid, count(DISTINCT sim_idx) AS episodes, count(DISTINCT line) AS lines, {r('min(len)')} AS min_len, {r('max(len)')} AS max_len FROM d GROUP BY grid""")
def grid_facts(spark, sf):
    d = pred(spark, sf).withColumn("len", F.pmod("line", F.lit(7)) * 0.5 + 1.0)
    return round_doubles(report.grid_facts(d, ["grid"], "sim_idx", "line", ["len"]))


@query("extremes_of_means", f"""{with_views(PRED, SCORED)}, m AS (SELECT grid, etype, avg(e) AS m FROM sc GROUP BY 1, 2)
SELECT grid, {r('min(m)')} AS min_mean, arg_min(etype, m) AS min_group, {r('max(m)')} AS max_mean, arg_max(etype, m) AS max_group FROM m GROUP BY grid""")
def extremes_of_means(spark, sf):
    return round_doubles(report.extremes_of_means(scored(spark, sf), ["grid"], "etype"))


BOARD = """board AS (SELECT o_orderstatus AS grid, CASE o_custkey % 3 WHEN 0 THEN 'fault_location_line' WHEN 1 THEN 'fault_location_local' ELSE 'fault_type' END AS task,
 CASE WHEN o_custkey % 5 = 0 THEN 'in_grid' ELSE 'held_out' END AS protocol, CASE WHEN o_orderkey % 7 = 0 THEN 'majority' ELSE 'net' || (o_orderkey % 11) END AS baseline,
 CASE WHEN o_orderkey % 4 = 0 THEN 'rmse' ELSE 'mae' END AS metric, 'benchmark' AS test_set, o_totalprice / 1000.0::DOUBLE AS mean FROM orders)"""


def board(spark, sf):
    o = fx.table(spark, sf, "orders")
    k, m = (lambda d: F.pmod("o_custkey", F.lit(d))), (lambda d: F.pmod("o_orderkey", F.lit(d)))
    return o.select(
        c("o_orderstatus").alias("grid"),
        F.when(k(3) == 0, "fault_location_line").when(k(3) == 1, "fault_location_local").otherwise("fault_type").alias("task"),
        F.when(k(5) == 0, "in_grid").otherwise("held_out").alias("protocol"),
        F.when(m(7) == 0, "majority").otherwise(F.concat(F.lit("net"), m(11))).alias("baseline"),
        F.when(m(4) == 0, "rmse").otherwise("mae").alias("metric"), F.lit("benchmark").alias("test_set"),
        (c("o_totalprice") / 1000.0).alias("mean"))


@query("leaderboard_best", f"""{with_views(BOARD)}, f AS (SELECT * FROM board WHERE starts_with(task, 'fault_location') AND metric = 'mae' AND test_set = 'benchmark' AND baseline != 'majority')
SELECT grid, task, protocol, baseline, {r('mean')} AS mean FROM (SELECT *, row_number() OVER (PARTITION BY grid, task, protocol ORDER BY mean, baseline) AS k FROM f) WHERE k = 1""")
def leaderboard_best(spark, sf):
    from faultspark.sources.tables import leaderboard_rows
    b = leaderboard_rows(board(spark, sf), "fault_location", "mae", "benchmark")
    return round_doubles(report.leaderboard_best(b, ["grid", "task", "protocol"]))


@query("relative_gain", f"""{with_views(PRED, SCORED)}
SELECT grid, {r('avg(e2)')} AS ours, {r('avg(e)')} AS base, {r('1 - avg(e2) / avg(e)')} AS reduction, {r('avg(e) / avg(e2)')} AS factor FROM sc GROUP BY grid""")
def relative_gain(spark, sf):
    return round_doubles(report.relative_gain(scored(spark, sf), ["grid"], "e2", "e"))


@query("conservative_gain", f"""{with_views(PRED, SCORED)}
SELECT grid, {r('1 - greatest(avg(e2), avg(e2 * 1.01::DOUBLE)) / least(avg(e), avg(e + 0.5))')} AS gain FROM sc GROUP BY grid""")
def conservative_gain(spark, sf):
    d = scored(spark, sf).withColumns({"e2b": c("e2") * 1.01, "eb": c("e") + 0.5})
    return round_doubles(report.conservative_gain(d, ["grid"], ["e2", "e2b"], ["e", "eb"]))


@query("verdicts", f"""{with_views(PRED, SCORED)}, m AS (SELECT grid, etype, avg(e) AS a, avg(e2) AS b FROM sc GROUP BY 1, 2)
SELECT grid, etype, CASE WHEN b <= 33 AND b <= 0.98::DOUBLE * a THEN 'PASS' ELSE 'FAIL' END AS verdict,
 CASE WHEN b <= 0.8::DOUBLE * a THEN 'claim' ELSE 'no claim' END AS claim, CASE WHEN a - b <= 1 THEN 'robust' ELSE 'not robust' END AS robust FROM m""")
def verdicts(spark, sf):
    m = scored(spark, sf).groupBy("grid", "etype").agg(F.avg("e").alias("a"), F.avg("e2").alias("b"))
    return m.select("grid", "etype", report.verdict(c("b"), c("a"), 33.0, 0.98).alias("verdict"),
                    report.claim(c("b"), c("a")).alias("claim"), report.robust(c("b"), c("a"), 1.0).alias("robust"))


@query("error_stats", f"""{with_views(PRED, SCORED)}
SELECT grid, count(*) AS n, {r('avg(e)')} AS mae, {r('avg(e * length_km * 10)')} AS mae_m, {r('quantile_cont(e, 0.95)')} AS p95, {r('quantile_cont(e * length_km * 10, 0.95)')} AS p95_m
FROM sc GROUP BY grid""")
def error_stats(spark, sf):
    return round_doubles(report.error_stats(scored(spark, sf), ["grid"]))


@query("format_metrics", f"""{with_views(PRED, SCORED)} SELECT etype || '_' || grid AS name, format('{{:,.2f}}', sum(e)) AS text, {r('floor(avg(e) / 0.1) * 0.1')} AS at_least FROM sc GROUP BY 1""")
def format_metrics(spark, sf):
    m = scored(spark, sf).groupBy(F.concat_ws("_", "etype", "grid").alias("name")).agg(F.sum("e").alias("v"), F.avg("e").alias("a"))
    text = joins.checked_unique(report.format_metrics(m, "name", "v", 2), ["name"], "metrics")
    return round_doubles(text.join(m.select("name", scalar.floor_to(c("a"), 0.1).alias("at_least")), "name"))


@query("named_metrics", f"""{with_views(PRED, SCORED)} SELECT 'error' || grid || replace(replace(etype, '_', ''), '1ph', 'Onep').replace('2ph', 'Twop') AS name, format('{{:,.2f}}', sum(e)) AS text FROM sc GROUP BY 1""")
def named_metrics(spark, sf):
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace("etype", "_", ""), "1ph", "Onep"), "2ph", "Twop")
    m = scored(spark, sf).groupBy(F.concat(F.lit("error"), "grid", kind).alias("name")).agg(F.sum("e").alias("v"))
    return report.named_metrics(m, "name", "v", 2)


@query("switch_rule", f"""{with_views(PRED)}
SELECT grid, {r(f"avg({err('CASE WHEN post_ms >= 20 - 1e-6 AND est IS NOT NULL THEN est ELSE est2 END')})")} AS mae FROM pred GROUP BY grid""")
def switch_rule_query(spark, sf):
    sw = switch_rule(c("post_ms"), c("est2"), c("est"))
    return round_doubles(pred(spark, sf).groupBy("grid").agg(F.avg(scalar.score(sw, c("y"))).alias("mae")))


@query("orientation_check", f"""{with_views(PRED)}
SELECT grid, count(*) AS n, {r(f'avg({E_EST})')} AS mae, {r(f"avg({err('est', '(1 - y)')})")} AS mae_reversed FROM pred GROUP BY grid""")
def orientation(spark, sf):
    return round_doubles(orientation_check(pred(spark, sf), ["grid"], "est", "y"))


# --- joins ---------------------------------------------------------------------------

KEY = ["grid", "sim_idx", "win"]


@query("join_one_to_one", f"""{with_views(PRED)}, b AS (SELECT grid, sim_idx, win, est2 AS other FROM pred WHERE line % 3 != 0)
SELECT grid, sim_idx, win, {r('est')} AS est, {r('other')} AS other FROM pred JOIN b USING (grid, sim_idx, win)""")
def join_one_to_one(spark, sf):
    p = pred(spark, sf)
    b = p.where(F.pmod("line", F.lit(3)) != 0).select(*KEY, c("est2").alias("other"))
    return round_doubles(joins.join_one_to_one(p.select(*KEY, "est"), b, KEY))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    """A key that a one-to-one join must reject."""
    return joins.duplicate_keys(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("join_complete", f"""{with_views(PRED)}
SELECT grid, sim_idx, k, {r('y')} AS y, {r('est2 * 2')} AS extra FROM (SELECT *, CAST(round(post_ms * 9.6::DOUBLE) AS INTEGER) AS k FROM pred)""")
def join_complete(spark, sf):
    p = joins.with_sample_key(pred(spark, sf))
    keys = ["grid", "sim_idx", "k"]
    out = joins.join_complete(p.select(*keys, "y"), p.select(*keys, (c("est2") * 2).alias("extra")), keys, ["extra"])
    return round_doubles(out)


@query("outer_indicator", f"""{with_views(PRED)}, a AS (SELECT * FROM pred WHERE win % 2 = 0), b AS (SELECT * FROM pred WHERE line % 2 = 0)
SELECT CASE WHEN a.win IS NOT NULL AND b.win IS NOT NULL THEN 'both' WHEN a.win IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS "_merge", count(*) AS n
FROM a FULL JOIN b USING (grid, sim_idx, win) GROUP BY 1""")
def outer_indicator(spark, sf):
    p = pred(spark, sf).select(*KEY, "line")
    a, b = p.where(F.pmod("win", F.lit(2)) == 0).select(*KEY), p.where(F.pmod("line", F.lit(2)) == 0).select(*KEY)
    return joins.join_outer_indicator(a, b, KEY).groupBy("_merge").agg(F.count(F.lit(1)).alias("n"))


@query("semi_join_split", f"""{with_views(PRED)} SELECT grid, count(*) AS n, {r(f'avg({E_EST})')} AS mae FROM pred
WHERE line IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 >= 8) GROUP BY grid""")
def semi_join_split(spark, sf):
    test = fx.table(spark, sf, "supplier").where(F.pmod("s_suppkey", F.lit(10)) >= 8).select(c("s_suppkey").alias("line"))
    d = joins.only_in(scored(spark, sf), test, ["line"])
    return round_doubles(d.groupBy("grid").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae")))


@query("anti_join_missing", """SELECT DISTINCT o_orderkey AS sim_idx FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def anti_join_missing(spark, sf):
    o = fx.table(spark, sf, "orders").select(c("o_orderkey").alias("sim_idx")).distinct()
    return joins.not_in(o, fx.table(spark, sf, "lineitem").select(c("l_orderkey").alias("sim_idx")), ["sim_idx"])


@query("split_overlap", f"""{with_views(PRED)} SELECT DISTINCT sim_idx FROM pred WHERE grid = 'O' AND sim_idx IN (SELECT sim_idx FROM pred WHERE grid = 'F')""")
def split_overlap(spark, sf):
    """Episodes in two grids at once: grid must be part of the key."""
    p = pred(spark, sf)
    return joins.overlap(p.where(c("grid") == "O"), p.where(c("grid") == "F"), ["sim_idx"])


@query("misaligned", f"""{with_views(PRED)} SELECT grid, sim_idx, win, CASE WHEN win = 7 THEN 'left_only' ELSE 'both' END AS "_merge" FROM pred
WHERE win = 7 OR (est IS NOT NULL AND line % 10 = 0)""")
def misaligned(spark, sf):
    p = pred(spark, sf)
    other = p.where(c("win") != 7).withColumn("est", F.when(F.pmod("line", F.lit(10)) == 0, c("est") + 0.01).otherwise(c("est")))
    return joins.misaligned(p, other, KEY, ["est"], 1e-9).select(*KEY, "_merge")


@query("assemble", f"""{with_views(PRED)} SELECT grid, sim_idx, win, {r(E_EST)} AS e_a, {r(E_EST2)} AS e_b, {r('length_km')} AS length_km FROM pred""")
def assemble(spark, sf):
    s = scored(spark, sf)
    parts = [s.select(*KEY, c("e").alias("e_a")), s.select(*KEY, c("e2").alias("e_b")), s.select(*KEY, "length_km")]
    return round_doubles(joins.assemble(s.select(*KEY), parts, KEY))


@query("assemble_stored", f"""{with_views(PRED)} SELECT grid, sim_idx, win, {r(E_EST)} AS e_a, {r(E_EST2)} AS e_b FROM pred WHERE est IS NOT NULL OR est2 > 0.5::DOUBLE""")
def assemble_stored(spark, sf):
    """The base and its parts stored once in buckets of the key: the chain of checked joins shuffles nothing."""
    s = scored(spark, sf).where(c("est").isNotNull() | (c("est2") > 0.5))
    n = buckets.bucket_count(fx.table(spark, sf, "lineitem").count())
    cut = lambda *cols: buckets.write_bucketed(s.select(*KEY, *cols), shared_path(spark, "parts"), KEY, n)
    return round_doubles(joins.assemble(cut(), [cut(c("e").alias("e_a")), cut(c("e2").alias("e_b"))], KEY))


@query("map_attribute", f"""{with_views(PRED)} SELECT grid, {r('avg(1.0::DOUBLE + (line % 7) * 0.5::DOUBLE)')} AS mean_len, count(*) AS n FROM pred GROUP BY grid""")
def map_attribute(spark, sf):
    dim = fx.line_params(spark, sf).select(c("rec").alias("line"), c("length_km").alias("len"))
    d = joins.map_attribute(pred(spark, sf), dim, ["line"], ["len"])
    return round_doubles(d.groupBy("grid").agg(F.avg("len").alias("mean_len"), F.count(F.lit(1)).alias("n")))


@query("best_then_rows", f"""{with_views(PRED, SEEDS)}, m AS (SELECT grid, seed, avg({err('pred')}) AS m FROM sd GROUP BY 1, 2),
b AS (SELECT grid, arg_min(seed, m) AS seed FROM m GROUP BY grid)
SELECT grid, seed AS model, count(*) AS n, {r('sum(pred)', 4)} AS total FROM sd JOIN b USING (grid, seed) GROUP BY 1, 2""")
def best_then_rows(spark, sf):
    d = seeded(spark, sf).withColumns({"e": scalar.score(c("pred"), c("y")), "model": c("seed")})
    out = joins.best_then_rows(d, ["grid"], "model", "e")
    return round_doubles(out.groupBy("grid", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("total")), 4)


# --- sorting, ranks and sets ---------------------------------------------------------------

@query("first_k", "SELECT l_suppkey, l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem) WHERE k <= 10")
def first_k(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    d = numbering.first_k(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 10)
    return d.select("l_suppkey", "l_orderkey", "l_partkey")


@query("number_rows", "SELECT l_suppkey, l_partkey, l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber) - 1 AS n FROM lineitem")
def number_rows(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_extendedprice", "l_linenumber")
    bucket = numbering.magnitude_bucket(c("l_extendedprice"), 64)
    return numbering.number_rows(li, ["l_suppkey"], ["l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber"], bucket).drop("l_linenumber")


@query("group_codes", "SELECT l_orderkey AS sim_idx, dense_rank() OVER (ORDER BY l_orderkey) - 1 AS code FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def group_codes(spark, sf):
    d = fx.table(spark, sf, "lineitem").select(c("l_orderkey").alias("sim_idx"))
    return numbering.group_codes(d, "sim_idx", F.floor(c("sim_idx") / 1024))


_H60 = "(('0x' || substr(md5({}), 1, 15))::BIGINT)"


@query("stratified_pick", f"""{with_views(PRED)}, u AS (SELECT DISTINCT etype, sim_idx FROM pred)
SELECT etype, sim_idx FROM (SELECT *, row_number() OVER (PARTITION BY etype ORDER BY {_H60.format("'0|' || sim_idx")}, sim_idx) AS k FROM u) WHERE k <= 4""")
def stratified_pick(spark, sf):
    return numbering.stratified_pick(pred(spark, sf), ["etype"], "sim_idx", 4)


@query("union_pooled", f"""{with_views(PRED)} SELECT grid, sim_idx, count(*) AS n FROM (SELECT grid, sim_idx FROM pred UNION ALL SELECT grid || '_b', sim_idx FROM pred WHERE win = 1) GROUP BY 1, 2""")
def union_pooled(spark, sf):
    """Pooled sets keep episodes apart by a composite key, not by id offsets."""
    p = pred(spark, sf).select("grid", "sim_idx", "win")
    q = p.where(c("win") == 1).withColumn("grid", F.concat("grid", F.lit("_b")))
    return p.unionByName(q).groupBy("grid", "sim_idx").agg(F.count(F.lit(1)).alias("n"))


@query("set_operations", """SELECT 'intersect' AS op, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'subtract', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def set_operations(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    a = li.where(c("l_returnflag") == "A").select("l_orderkey")
    b = li.where(c("l_returnflag") == "R").select("l_orderkey")
    n = lambda d, op: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n(a.intersect(b), "intersect").unionByName(n(a.subtract(b), "subtract"))


# --- quality -----------------------------------------------------------------------------------

VALUES = f"""v AS (SELECT grid, sim_idx, win, etype, est, est2, CASE WHEN line % 10 = 0 THEN est + 0.0005::DOUBLE WHEN line % 10 = 1 THEN est * 1.1::DOUBLE ELSE est END AS n_est,
  CASE WHEN line % 13 = 0 THEN NULL ELSE est2 END AS n_est2, line FROM pred)"""


def two_versions(spark, sf):
    p = pred(spark, sf).select(*KEY, "etype", "line", "est", "est2")
    m = F.pmod("line", F.lit(10))
    new = p.withColumns({"est": F.when(m == 0, c("est") + 0.0005).when(m == 1, c("est") * 1.1).otherwise(c("est")),
                         "est2": F.when(F.pmod("line", F.lit(13)) != 0, c("est2"))})
    return p, new


def _cmp(a, b, name):
    return (f"SELECT '{name}' AS \"column\", count(abs({a} - {b})) AS n, {r(f'max(abs({a} - {b}))')} AS max_abs, sum(CAST(abs({a} - {b}) > 1e-6 AS INTEGER)) AS n_gt_1e6, "
            f"sum(CAST(abs({a} - {b}) > 1e-3 AS INTEGER)) AS n_gt_1e3, sum(CAST(({a} IS NULL) != ({b} IS NULL) AS INTEGER)) AS n_one_null, {r(f'quantile_cont(abs({a} - {b}), 0.99)')} AS p99 FROM v")


@query("compare_tables", f"{with_views(PRED, VALUES)} {_cmp('est', 'n_est', 'est')} UNION ALL {_cmp('est2', 'n_est2', 'est2')}")
def compare_tables(spark, sf):
    a, b = two_versions(spark, sf)
    return round_doubles(quality.compare_tables(a, b, KEY, ["est", "est2"]))


@query("check_values", f"""{with_views(PRED, SCORED)}, a AS (SELECT grid, etype, avg(e) AS v, CASE WHEN etype LIKE '%hif' AND grid = 'F' THEN NULL ELSE avg(e) + CASE grid WHEN 'O' THEN 0.02 ELSE 0.005 END END AS s FROM sc GROUP BY 1, 2)
SELECT grid, etype, {r('v')} AS validated, {r('s')} AS stored, {r('abs(v - s)')} AS abs_dev, 0.01::DOUBLE AS tol, coalesce(abs(v - s) <= 0.01, false) AS ok FROM a""")
def check_values(spark, sf):
    a = scored(spark, sf).groupBy("grid", "etype").agg(F.avg("e").alias("value"))
    gap = F.when(c("grid") == "O", 0.02).otherwise(0.005)
    stored = a.withColumn("value", F.when(~(c("etype").endswith("hif") & (c("grid") == "F")), c("value") + gap))
    return round_doubles(quality.check(a, stored, ["grid", "etype"], 0.01))


@query("mismatch_counts", f"""{with_views(PRED, VALUES)}
SELECT count(*) FILTER (win != 7) AS "both", count(*) FILTER (win = 7) AS left_only, 0::BIGINT AS right_only,
 count(*) FILTER (win != 7 AND est IS DISTINCT FROM n_est) AS diff_est, count(*) FILTER (win != 7 AND est2 IS DISTINCT FROM n_est2) AS diff_est2 FROM v""")
def mismatch_counts(spark, sf):
    a, b = two_versions(spark, sf)
    return quality.mismatch_counts(a, b.where(c("win") != 7), KEY, ["est", "est2"])


@query("largest_differences", f"""{with_views(PRED, VALUES)}, d AS (SELECT grid, sim_idx, win, 'est' AS "column", abs(est - n_est) AS dev FROM v WHERE est IS NOT NULL)
SELECT grid, sim_idx, win, "column", {r('dev')} AS dev FROM d ORDER BY d.dev DESC, grid, sim_idx, win LIMIT 25""")
def largest_differences(spark, sf):
    a, b = two_versions(spark, sf)
    return round_doubles(quality.largest_differences(a, b, KEY, ["est"], 25))


@query("guard_small", f"""{with_views(PRED)}
SELECT grid, sim_idx, win, {r('CASE WHEN est2 < 1e-6 THEN 0.0 ELSE rho END')} AS i0c, {r('CASE WHEN est2 < 1e-6 THEN 0.5 ELSE est END')} AS ag_tak0 FROM pred""")
def guard_small_query(spark, sf):
    d = pred(spark, sf).select(*KEY, c("est2").alias("i0r"), c("rho").alias("i0c"), c("est").alias("ag_tak0"))
    return round_doubles(guard_small(d, zero_cols=("i0c",), half_cols=("ag_tak0",)).drop("i0r"))


@query("change_audit", f"""{with_views(PRED)}, a AS (SELECT *, est2 < 1e-6 AS hit, CASE WHEN est2 < 1e-6 THEN 0.5 ELSE est END AS n_est FROM pred)
SELECT etype, count(*) AS n, sum(CAST(hit AS INTEGER)) AS masked, sum(CAST(hit AND est IS DISTINCT FROM n_est AS INTEGER)) AS changed, 0::BIGINT AS changed_outside, 0::BIGINT AS changed_other, 'patch' AS run FROM a GROUP BY etype
UNION ALL SELECT etype, count(*), sum(CAST(hit AS INTEGER)), sum(CAST(hit AND est IS DISTINCT FROM n_est AS INTEGER)),
  sum(CAST(NOT hit AND win = 2 AND est IS NOT NULL AS INTEGER)), sum(CAST(win = 3 AS INTEGER)), 'stray' FROM a GROUP BY etype""")
def change_audit(spark, sf):
    """The patch as intended, and one that also strays outside its mask and into another column."""
    old = pred(spark, sf).select(*KEY, "etype", "y", "est", "est2")
    new = guard_small(old, "est2", zero_cols=(), half_cols=("est",))
    stray = new.withColumns({"est": F.when((c("win") == 2) & (c("est2") >= 1e-6), c("est") + 0.25).otherwise(c("est")),
                             "y": F.when(c("win") == 3, c("y") + 0.5).otherwise(c("y"))})
    runs = [quality.change_audit(old, n, KEY, ["est"], c("est2") < 1e-6, ["etype"]).withColumn("run", F.lit(name))
            for name, n in (("patch", new), ("stray", stray))]
    return runs[0].unionByName(runs[1])


@query("mask_agreement", f"""{with_views(PRED)}, m AS (SELECT grid, est < 0.3 AS a, est2 < 0.3 AS b FROM pred)
SELECT grid, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (NOT a AND b) AS second_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM m GROUP BY grid""")
def mask_agreement(spark, sf):
    return quality.mask_agreement(pred(spark, sf), ["grid"], c("est") < 0.3, c("est2") < 0.3)


_FP = "concat_ws('|', grid, sim_idx, win, CAST(round(est2 * 1000000) AS BIGINT), coalesce(CAST(CAST(round(est * 1000000) AS BIGINT) AS VARCHAR), 'NULL'))"


@query("fingerprint", f"""{with_views(PRED)} SELECT etype, count(*) AS rows, CAST(sum({_H60.format(_FP)}::HUGEINT) AS VARCHAR) AS digest FROM pred GROUP BY etype""")
def fingerprint(spark, sf):
    return quality.fingerprint(pred(spark, sf), ["grid", "sim_idx", "win", "est2", "est"], ["etype"])


@query("agreement", f"""{with_views(PRED)} SELECT grid, count(*) AS n, {r('avg(abs(est - est2))')} AS mean_abs, {r('corr(est, est2)')} AS r, {r('quantile_cont(abs(est - est2), 0.95)')} AS p95
FROM pred WHERE est IS NOT NULL GROUP BY grid""")
def agreement(spark, sf):
    return round_doubles(quality.agreement(pred(spark, sf), ["grid"], "est", "est2"))


@query("metric_delta", f"""{with_views(PRED, SCORED)}, o AS (SELECT etype, avg(e) AS v FROM sc WHERE grid = 'O' GROUP BY 1), f AS (SELECT etype, avg(e) AS v FROM sc WHERE grid = 'F' GROUP BY 1)
SELECT etype, {r('o.v')} AS old, {r('f.v')} AS "new", {r('f.v - o.v')} AS delta FROM o FULL JOIN f USING (etype)""")
def metric_delta(spark, sf):
    m = scored(spark, sf).groupBy("grid", "etype").agg(F.avg("e").alias("value"))
    return round_doubles(quality.metric_delta(m.where(c("grid") == "O"), m.where(c("grid") == "F"), ["etype"]))


@query("identity_property", """SELECT count(*) AS n, true AS holds, false AS holds_perturbed FROM lineitem""")
def identity_property(spark, sf):
    """The error identity on complex cases drawn from the line items.

    With loop current I, fault current IF and V = d Z I + Rf IF, the reactance
    error equals rho * |IF/I| * sin(beta) / sin(theta). With the prediction off
    by a thousandth the gate must say no.
    """
    li = fx.table(spark, sf, "lineitem")
    z = Cx(c("l_quantity") / 500.0 + 0.01, c("l_extendedprice") / 1e5 + 0.2)
    i = Cx(c("l_discount") * 10.0 + 0.3, c("l_tax") * 10.0 - 0.4)
    f = Cx(F.pmod("l_partkey", F.lit(17)) / 9.0 - 1.0, F.pmod("l_orderkey", F.lit(13)) / 7.0 - 0.9)
    rf, d = F.pmod("l_suppkey", F.lit(40)) * 1.0, c("l_quantity") / 50.0
    v = z * i * d + f * rf
    e_obs = (v / i).im / z.im - d
    k = f / i
    e_pred = rf / z.abs() * k.abs() * F.sin(k.arg()) / F.sin(z.arg())
    return li.agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(e_obs - e_pred)) < 1e-9).alias("holds"),
                  (F.max(F.abs(e_obs - e_pred * 1.001)) < 1e-9).alias("holds_perturbed"))


@query("wrap_angle", f"""SELECT l_orderkey, l_linenumber, l_partkey, {r('atan2(sin(l_quantity), cos(l_quantity))')} AS a, {r('(l_quantity + pi()) - 2 * pi() * floor((l_quantity + pi()) / (2 * pi())) - pi()')} AS b FROM lineitem""")
def wrap_angle(spark, sf):
    import math
    from faultspark.functions.cplx import wrap_angle as wrap
    q = c("l_quantity")
    return round_doubles(fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", wrap(q).alias("a"),
        (F.pmod(q + math.pi, F.lit(2 * math.pi)) - math.pi).alias("b")))


# --- resampling and baselines ---------------------------------------------------------------------

B = 50
_BOOT = f"""es AS (SELECT grid, sim_idx, sum(e) AS se, sum(e2) AS se2, count(*) AS w FROM sc GROUP BY 1, 2),
ei AS (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY sim_idx) - 1 AS idx, count(*) OVER (PARTITION BY grid) AS n_ep FROM es),
dr AS (SELECT grid, rep, {_H60.format("'0|' || rep || '|' || idx")} % n_ep AS pick FROM ei, range(0, {B}) t(rep)),
rp AS (SELECT d.grid, d.rep, sum(se) AS se, sum(se2) AS se2, sum(w) AS w FROM dr d JOIN ei e ON e.grid = d.grid AND e.idx = d.pick GROUP BY 1, 2)"""


@query("bootstrap_ci", f"""{with_views(PRED, SCORED, _BOOT)}
SELECT grid, any_value(n) AS n, {r('any_value(mae)')} AS mae, {r('quantile_cont(se / w, 0.025)')} AS ci_lo, {r('quantile_cont(se / w, 0.975)')} AS ci_hi
FROM rp JOIN (SELECT grid, count(*) AS n, avg(e) AS mae FROM sc GROUP BY grid) USING (grid) GROUP BY grid""")
def bootstrap_ci(spark, sf):
    return round_doubles(resample.bootstrap_ci(scored(spark, sf), ["grid"], "sim_idx", c("e"), B, 0, "hash"))


@query("paired_reduction", f"""{with_views(PRED, SCORED, _BOOT)}
SELECT grid, {r('any_value(red)')} AS reduction, {r('quantile_cont((1 - se2 / se) * 100, 0.025)')} AS ci_lo, {r('quantile_cont((1 - se2 / se) * 100, 0.975)')} AS ci_hi
FROM rp JOIN (SELECT grid, (1 - sum(e2) / sum(e)) * 100 AS red FROM sc GROUP BY grid) USING (grid) GROUP BY grid""")
def paired_reduction(spark, sf):
    return round_doubles(resample.paired_reduction(scored(spark, sf), ["grid"], "sim_idx", c("e2"), c("e"), B, 0, "hash"))


@query("bootstrap_multinomial", f"""{with_views(PRED, SCORED)} SELECT grid, count(*) AS n, {r('avg(e)')} AS mae, true AS holds, true AS width_ok FROM sc GROUP BY grid""")
def bootstrap_multinomial(spark, sf):
    """2000 replicates with counts drawn inside bounded buckets.

    The interval must hold the mean error, and be as wide as the normal one of
    the ratio of episode sums within a fifth.
    """
    d = scored(spark, sf)
    ci = resample.bootstrap_ci(d, ["grid"], "sim_idx", c("e"), 2000, 0)
    mean = d.groupBy("grid").agg(F.avg("e").alias("mae"))  # not from ci, whose replicates would be drawn twice
    ep = resample.episode_sums(d, ["grid"], "sim_idx", {"s": c("e")}).join(mean, "grid")
    se = ep.groupBy("grid").agg((F.sqrt(F.sum((c("s") - c("mae") * c("wins")) ** 2)) / F.sum("wins")).alias("se"))
    width = (c("ci_hi") - c("ci_lo")) / (c("se") * 2 * 1.96)
    out = ci.join(se, "grid").select("grid", "n", "mae", ((c("ci_lo") < c("mae")) & (c("mae") < c("ci_hi"))).alias("holds"),
                                     ((width > 0.8) & (width < 1.25)).alias("width_ok"))
    return round_doubles(out)


_GS = f"""eh AS (SELECT DISTINCT sim_idx FROM pred), er AS (SELECT sim_idx, row_number() OVER (ORDER BY {_H60.format("'0|' || sim_idx")}, sim_idx) - 1 AS rk, count(*) OVER () AS n FROM eh)"""


@query("grouped_split", f"""{with_views(PRED, _GS)}
SELECT CASE WHEN rk < round_even(n * 0.3::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split, count(*) AS windows, count(DISTINCT sim_idx) AS episodes FROM pred JOIN er USING (sim_idx) GROUP BY 1""")
def grouped_split(spark, sf):
    return windows.count_windows(resample.grouped_split(pred(spark, sf), ["sim_idx"]), ["split"], ["sim_idx"])


@query("grouped_validation", f"""{with_views(PRED, _GS)}
SELECT rk < greatest(1, n // 10) AS is_val, count(*) AS windows, count(DISTINCT sim_idx) AS episodes FROM pred JOIN er USING (sim_idx) GROUP BY 1""")
def grouped_validation(spark, sf):
    return windows.count_windows(resample.grouped_validation(pred(spark, sf), ["sim_idx"]), ["is_val"], ["sim_idx"])


@query("calibrated_ratio", f"""{with_views(PRED)}, f AS (SELECT regr_intercept(y, est) AS a, regr_slope(y, est) AS b FROM pred WHERE grid = 'O')
SELECT etype, {r('any_value(a)')} AS coef_a, {r('any_value(b)')} AS coef_b, {r(f"avg({err('a + b * est')})")} AS mae FROM pred, f WHERE grid = 'F' GROUP BY etype""")
def calibrated_ratio(spark, sf):
    p = pred(spark, sf)
    d = resample.calibrated_ratio(p.where(c("grid") == "O"), p.where(c("grid") == "F"), "est", "y")
    return round_doubles(d.groupBy("etype").agg(F.first("coef_a").alias("coef_a"), F.first("coef_b").alias("coef_b"),
                                                F.avg(scalar.score(c("cal"), c("y"))).alias("mae")))


@query("constant_baseline", f"""{with_views(PRED)}, f AS (SELECT quantile_cont(y, 0.5) AS m FROM pred WHERE grid = 'O')
SELECT etype, {r(f"avg({err('m')})")} AS mae FROM pred, f WHERE grid = 'F' GROUP BY etype""")
def constant_baseline(spark, sf):
    p = pred(spark, sf)
    d = resample.constant_baseline(p.where(c("grid") == "O"), p.where(c("grid") == "F"), "y")
    return round_doubles(d.groupBy("etype").agg(F.avg(scalar.score(c("const"), c("y"))).alias("mae")))


@query("standardise_on_train", f"""{with_views(PRED)}, f AS (SELECT avg(rho) AS m, stddev_pop(rho) AS s, avg(r_f) AS m2, stddev_pop(r_f) AS s2 FROM pred WHERE grid = 'O')
SELECT grid, sim_idx, win, {r('(rho - m) / (s + 1e-6)')} AS rho, {r('(r_f - m2) / (s2 + 1e-6)')} AS r_f FROM pred, f""")
def standardise_on_train(spark, sf):
    d = resample.standardise_on_train(pred(spark, sf), ["rho", "r_f"], c("grid") == "O")
    return round_doubles(d.select(*KEY, "rho", "r_f"))


@query("score_predictions", f"""{with_views(PRED, SEEDS)} SELECT grid AS direction, seed, count(*) AS n, {r(f"avg({err('pred')})")} AS validated, round({r(f"avg({err('pred')})", 3)} + CASE WHEN seed = 2 THEN 0.5 ELSE 0 END, 6) AS stored, seed <> 2 AS ok FROM sd GROUP BY 1, 2""")
def score_predictions(spark, sf):
    """Re-scored predictions against stored values within 0.01 points; those of seed 2 are off by half a point."""
    d = seeded(spark, sf).withColumn("e", scalar.score(c("pred"), c("y")))
    m = d.groupBy(c("grid").alias("direction"), "seed").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("value"))
    stored = round_doubles(m, 3).withColumn("value", c("value") + F.when(c("seed") == 2, 0.5).otherwise(0.0))
    out = quality.check(m, stored, ["direction", "seed"], 0.01)
    return round_cols(m.select("direction", "seed", "n").join(out, ["direction", "seed"]).drop("abs_dev", "tol"), ["validated", "stored"])
