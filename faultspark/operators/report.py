"""Scores and reports over per-window estimate tables.

All reports are grouped aggregates that combine map-side; medians and other
quantiles come from :mod:`faultspark.operators.numbering`, so no group is held
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.functions.scalar import bucketise, is_incipient, is_transient, ladder, score, to_metres
from faultspark.operators.joins import checked_unique, must
from faultspark.operators.numbering import best_row, column_quantiles, join_groups, quantiles

# --- fixed bin edges of the reports -------------------------------------------
TIME_EDGES = [0.0, 17.5, 32.5, 52.5, float("inf")]
TIME_LABELS = ["<=15", "20-30", "35-50", ">=55"]
LADDER_TOPS = [15.0, 30.0, 50.0]
TAU_EDGES = [0.0, 3.0, 5.0, 7.5, 10.0, 15.0, 21.0, 50.0, 1000.0]
RHO_EDGES = [0.0, 0.3, 1.0, 3.0, 10.0, 30.0, 1e9]
RESISTANCE_TOPS = [1.0, 10.0, 25.0]
RESISTANCE_LABELS = ["<=1", "1-10", "10-25", ">25"]
# --------------------------------------------------------------------------------


def mean_where(x: Column, cond: Column) -> Column:
    return F.avg(F.when(cond, x))


def share(cond: Column) -> Column:
    """Share of rows where the condition holds; NULL conditions leave."""
    return F.avg(cond.cast("double"))


def with_quantiles(agg: DataFrame, df: DataFrame, by: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    q = quantiles(df, by, x, probs)
    if by:
        return join_groups(agg, q, by, "left")
    row = agg.withColumn("_row", q.select(F.struct(*probs)).scalar())
    return row.withColumns({k: F.col(f"_row.{k}") for k in probs}).drop("_row")


def summary(df: DataFrame, by: list[str], err: str = "e", episode: str = "sim_idx",
            post: str = "post_ms", etype: str = "etype") -> DataFrame:
    """Size, episodes, mean and median error, early, late and short-circuit means."""
    e, p = F.col(err), F.col(post)
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(episode).alias("episodes"), F.avg(e).alias("mae"),
        mean_where(e, p <= 15).alias("mae_le15"), mean_where(e, p >= 21).alias("mae_ge21"),
        mean_where(e, ~is_incipient(F.col(etype))).alias("mae_non_incipient"))
    return with_quantiles(agg, df, by, err, {"median": 0.5})


def long_estimates(df: DataFrame, keep: list[str], methods: dict[str, str]) -> DataFrame:
    """One row per window and method; ``methods`` maps label to column."""
    cells = [F.struct(F.lit(k).alias("method"), F.col(v).cast("double").alias("est")) for k, v in methods.items()]
    return df.select(*keep, F.inline(F.array(*cells)))


def time_bin_report(df: DataFrame, by: list[str], methods: dict[str, str], y: str = "y", post: str = "post_ms",
                    etype: str = "etype") -> DataFrame:
    """Per method: counts, mean, median and mean error per post-fault bin."""
    long = long_estimates(df, [*by, y, post, etype], methods)
    long = long.withColumn("e", score(F.col("est"), F.col(y)))
    p, e = F.col(post), F.col("e")
    keys = [*by, "method"]
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("est").isNull().cast("int")).alias("n_undefined"),
            F.avg(e).alias("mae"), mean_where(e, ~is_transient(F.col(etype))).alias("mae_sc")]
    for a, b, lab in zip(TIME_EDGES, TIME_EDGES[1:], TIME_LABELS):
        aggs.append(mean_where(e, (p > a) & (p <= b)).alias(f"post {lab}"))
    return with_quantiles(long.groupBy(*keys).agg(*aggs), long, keys, "e", {"median": 0.5})


def binned(df: DataFrame, by: list[str], label: Column, err: str = "e", name: str = "bin") -> DataFrame:
    """Count, mean and median error per interval; unbinned rows are left out."""
    d = df.withColumn(name, label).where(F.col(name).isNotNull())
    keys = [*by, name]
    agg = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("mean"))
    return with_quantiles(agg, d, keys, err, {"median": 0.5})


def bin_tau(x: Column) -> Column:
    return bucketise(x, TAU_EDGES, closed="left")


def bin_time(x: Column) -> Column:
    return bucketise(x, TIME_EDGES, TIME_LABELS)


def bin_time_ladder(x: Column) -> Column:
    """Edges on the 5 ms grid; differs from :func:`bin_time` off that grid."""
    return ladder(x, LADDER_TOPS, TIME_LABELS)


def bin_rho(x: Column, closed: str = "right") -> Column:
    return bucketise(x, RHO_EDGES, closed=closed)


def bin_resistance(x: Column) -> Column:
    return ladder(x, RESISTANCE_TOPS, RESISTANCE_LABELS)


def rho_bins(df: DataFrame, by: list[str], methods: dict[str, str], only_defined: list[str], y: str = "y",
             rho: str = "rho", closed: str = "right") -> DataFrame:
    """Mean error per severity bin and method.

    Methods in ``only_defined`` drop windows without an estimate; for the
    others an undefined estimate scores as mid-line.
    """
    long = long_estimates(df, [*by, y, rho], methods)
    long = long.where(~F.col("method").isin(only_defined) | F.col("est").isNotNull())
    long = long.withColumns({"rho_bin": bin_rho(F.col(rho), closed), "e": score(F.col("est"), F.col(y))})
    return (long.where(F.col("rho_bin").isNotNull()).groupBy(*by, "method", "rho_bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae")))


def per_time_curve(df: DataFrame, direction: str, post: str, errors: list[str]) -> DataFrame:
    """Mean errors per rounded time and for all times, in one aggregate."""
    d = df.withColumn("t", F.bround(post, 0).cast("int"))
    cols = [F.col(direction), F.col("t")]
    return (d.groupingSets([cols, cols[:1]], *cols)
            .agg(F.grouping("t").alias("is_total"), F.count(F.lit(1)).alias("n"), *[F.avg(e).alias(e) for e in errors])
            .withColumn("t", F.when(F.col("is_total") == 1, "all").otherwise(F.col("t").cast("string"))).drop("is_total"))


def pivot_report(df: DataFrame, row: list[str], col: str, values: list[str], x: str) -> DataFrame:
    """Rows by columns of mean values; the column list is given, not queried."""
    return df.groupBy(*row).pivot(col, values).agg(F.avg(x))


def tidy(df: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """(keys, stat, value) rows; undefined values are left out."""
    long = df.select(*keys, *[F.col(s).cast("double").alias(s) for s in stats])
    return long.unpivot(keys, stats, "stat", "value").where(F.col("value").isNotNull())


def seed_spread(df: DataFrame, by: list[str], seed: str = "seed", err: str = "e") -> DataFrame:
    """Mean and sample deviation over seeds of the per-seed mean error."""
    per = df.groupBy(*by, seed).agg(F.avg(err).alias("_m"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("seeds"), F.avg("_m").alias("mean"),
                                F.stddev_samp("_m").alias("std"))


def seed_ensemble(df: DataFrame, window: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Error of the mean prediction, next to the mean of per-seed errors."""
    return df.groupBy(*window).agg(
        F.first(y).alias(y), F.avg(pred).alias("ensemble"),
        F.avg(score(F.col(pred), F.col(y))).alias("e_mean_of_seeds")).withColumn(
        "e_ensemble", score(F.col("ensemble"), F.col(y)))


def coverage(df: DataFrame, by: list[str], est: str, y: str = "y", post: str = "post_ms",
             can: Column | None = None) -> DataFrame:
    """Share and error of defined estimates, for all, early and late windows.

    ``can`` marks windows that could have an estimate at all; the share over
    those is reported next to the share over every window.
    """
    p, ok = F.col(post), F.col(est).isNotNull()
    e = score(F.col(est), F.col(y))
    aggs = []
    for nm, m in (("all", F.lit(True)), ("le15", p <= 15 + 1e-6), ("ge20", p >= 20 - 1e-6)):
        aggs.append(mean_where(e, m & ok).alias(f"mae_{nm}"))
        aggs.append((F.avg(F.when(m, ok.cast("double"))) * 100).alias(f"coverage_{nm}"))
        if can is not None:
            aggs.append((F.avg(F.when(m & can, ok.cast("double"))) * 100).alias(f"coverage_possible_{nm}"))
    return df.groupBy(*by).agg(*aggs)


def middle_shares(df: DataFrame, by: list[str], est: str, y: str = "y", near: float = 0.02) -> DataFrame:
    """Share of mid-line labels and of estimates close to mid-line."""
    from faultspark.functions.scalar import clip

    mid = F.abs(F.col(y) - 0.5) < 1e-9
    close = F.abs(clip(F.coalesce(F.col(est), F.lit(0.5)), 0, 1) - 0.5) <= near
    return df.groupBy(*by).agg(share(mid).alias("share_mid"), share(close).alias("share_near_mid"),
                               mean_where(close.cast("double"), mid).alias("share_near_given_mid"))


def exclude_constant_label(df: DataFrame, y: str = "y", value: float = 0.5) -> DataFrame:
    return df.where(F.abs(F.col(y) - value) >= 1e-9)


def prefault_cost(df: DataFrame, by: list[str], err: str = "e", post: str = "post_ms") -> DataFrame:
    """Error of windows that still hold pre-fault samples, and of the others."""
    p, e = F.col(post), F.col(err)
    return df.groupBy(*by).agg(mean_where(e, p <= 50).alias("with_prefault"), mean_where(e, p > 52.5).alias("post_only"))


def conditioning_report(df: DataFrame, by: list[str], episode: list[str]) -> DataFrame:
    """Identity deviation, severity, amplification and angle error per group."""
    c = F.col
    d = df.withColumns({
        "_dR": F.abs(c("e_obs_R") - c("e_pred_R")) * 100, "_dT": F.abs(c("e_obs_T") - c("e_pred_T")) * 100,
        "_oR": F.abs("e_obs_R") * 100, "_oT": F.abs("e_obs_T") * 100,
        "_k": F.abs("kappa_T"), "_a": F.abs("angerr_T_deg")})
    agg = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*episode).alias("episodes"),
                             share(c("Dreq_deg") < 1).alias("share_dreq_lt1"))
    wanted = [("_dR", {"ident_R_med": 0.5, "ident_R_p90": 0.9}), ("_dT", {"ident_T_med": 0.5, "ident_T_p90": 0.9}),
              ("_oR", {"med_abs_eobs_R": 0.5}), ("_oT", {"med_abs_eobs_T": 0.5}),
              ("rho", {"rho_med": 0.5, "rho_p90": 0.9}), ("_k", {"kappaT_med": 0.5}),
              ("_a", {"angerr_T_med": 0.5, "angerr_T_p90": 0.9}), ("Dreq_deg", {"Dreq_med": 0.5})]
    return agg.join(column_quantiles(d, by, dict(wanted)), by, "left")


def scenario_table(df: DataFrame, by: list[str], errors: dict[str, str], flag: str = "sat",
                   post: str = "post_ms") -> DataFrame:
    """Mean errors per scenario, flagged share, and errors of flagged windows."""
    hit = F.col(flag) == 1
    aggs = [F.count(F.lit(1)).alias("n"), (share(hit) * 100).alias("flagged_pct")]
    for lab, c in errors.items():
        e = F.col(c)
        aggs += [F.avg(e).alias(lab), mean_where(e, hit).alias(f"{lab}_flagged"),
                 mean_where(e, F.col(post) <= 15).alias(f"{lab}_le15"), mean_where(e, F.col(post) >= 21).alias(f"{lab}_ge21")]
    return df.groupBy(*by).agg(*aggs)


def sweep_table(df: DataFrame, by: list[str], columns: list[str], y: str = "y") -> DataFrame:
    """Mean error per perturbation column; names with dots come in backticks."""
    long = long_estimates(df, [*by, y], {c.strip("`"): c for c in columns})
    return long.groupBy(*by, "method").agg(F.count(F.lit(1)).alias("n"), F.avg(score(F.col("est"), F.col(y))).alias("mae"))


def grid_facts(df: DataFrame, by: list[str], episode: str, line: str, facts: list[str]) -> DataFrame:
    """Episodes, lines, and the range of line attributes over distinct lines."""
    per_line = df.groupBy(*by, line).agg(*[F.min(f).alias(f) for f in facts])
    rng = per_line.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"),
        *[a for f in facts for a in (F.min(f).alias(f"min_{f}"), F.max(f).alias(f"max_{f}"))])
    return df.groupBy(*by).agg(F.countDistinct(episode).alias("episodes")).join(rng, by)


def extremes_of_means(df: DataFrame, by: list[str], group: str, err: str = "e") -> DataFrame:
    """Smallest and largest group mean, with the groups' names."""
    per = df.groupBy(*by, group).agg(F.avg(err).alias("_m"))
    pick = lambda f: f(group, F.struct(F.col("_m"), F.col(group)))
    return per.groupBy(*by).agg(F.min("_m").alias("min_mean"), pick(F.min_by).alias("min_group"),
                                F.max("_m").alias("max_mean"), pick(F.max_by).alias("max_group"))


def leaderboard_best(board: DataFrame, by: list[str], metric: str = "mean", name: str = "baseline") -> DataFrame:
    """Best published row per group; ties go to the first name."""
    cols = [*by, name, metric]
    return best_row(board.select(*cols), by, F.col(metric), F.col(name))


def relative_gain(df: DataFrame, by: list[str], ours: str, base: str) -> DataFrame:
    """1 - ours/base and base/ours from mean errors."""
    a, b = F.avg(ours), F.avg(base)
    return df.groupBy(*by).agg(a.alias("ours"), b.alias("base"), (F.lit(1.0) - F.try_divide(a, b)).alias("reduction"),
                               F.try_divide(b, a).alias("factor"))


def conservative_gain(df: DataFrame, by: list[str], ours: list[str], base: list[str]) -> DataFrame:
    """Worse of our means against the better of the baseline means."""
    a = F.greatest(*[F.avg(x) for x in ours]) if len(ours) > 1 else F.avg(ours[0])
    b = F.least(*[F.avg(x) for x in base]) if len(base) > 1 else F.avg(base[0])
    return df.groupBy(*by).agg((F.lit(1.0) - F.try_divide(a, b)).alias("gain"))


def verdict(mae: Column, best: Column, bar: float, factor: float = 0.8) -> Column:
    """PASS when below the bar and clearly below the best comparison."""
    return F.when((mae <= bar) & (mae <= best * factor), "PASS").otherwise("FAIL")


def claim(mae: Column, best: Column, factor: float = 0.8) -> Column:
    return F.when(mae <= best * factor, "claim").otherwise("no claim")


def robust(clean: Column, noisy: Column, limit_pp: float) -> Column:
    return F.when(noisy - clean <= limit_pp, "robust").otherwise("not robust")


def error_stats(df: DataFrame, by: list[str], err: str = "e", length: str = "length_km") -> DataFrame:
    """n, mean and P95 in percent and in metres."""
    d = df.where(F.col(err).isNotNull()).withColumn("_m", to_metres(F.col(err), F.col(length)))
    agg = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"), F.avg("_m").alias("mae_m"))
    return agg.join(column_quantiles(d, by, {err: {"p95": 0.95}, "_m": {"p95_m": 0.95}}), by, "left")


def format_metrics(df: DataFrame, name: str, value: str, digits: int) -> DataFrame:
    """Display text with thousands separators, one row per metric name."""
    return df.select(F.col(name), F.format_number(value, digits).alias("text"))


def named_metrics(df: DataFrame, name: str, value: str, digits: int) -> DataFrame:
    """Display texts under names made of letters only, each once; the first other name fails the job."""
    ok = F.coalesce(F.col(name).rlike("^[A-Za-z]+$"), F.lit(False))
    return format_metrics(checked_unique(must(df, ok, f"{name}: a metric is named by letters only"), [name], "metrics"), name, value, digits)
