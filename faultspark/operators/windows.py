"""Event windows and the pane engine.

A window is a whole number of hops, so every window sum is a sum of hop-sized
panes. Samples are reduced to panes once and panes are rolled into windows;
samples are never copied per window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.config import SignalConfig
from faultspark.functions.scalar import floor_sample, half_even_sample, is_incipient
from faultspark.operators.blocks import halo_blocks, owned_windows


# --- which windows are wanted (computed from labels alone) -------------------

def event_windows(episodes: DataFrame, cfg: SignalConfig) -> DataFrame:
    """Ends at 5, 10, ... ms after inception: to 80 ms, incipient to 50 ms."""
    top = F.when(is_incipient(F.col("etype")), 50).otherwise(80)
    nf = half_even_sample(F.col("event_start"), cfg.t0, cfg.fs)
    return (episodes.withColumn("nf", nf)
            .select("*", F.explode(F.sequence(F.lit(5), top, F.lit(5))).alias("tau"))
            .withColumn("win_end", F.col("nf") + F.bround(F.col("tau") / 1000.0 * cfg.fs, 0).cast("int")))


def active_length(cfg: SignalConfig) -> Column:
    return F.when(is_incipient(F.col("etype")), F.floor(F.col("duration") * cfg.fs)).otherwise(cfg.active_len)


def record_lengths(samples: DataFrame, keys: list[str], out: str = "n_samples") -> DataFrame:
    """Number of samples per record, counted from index zero."""
    return samples.groupBy(*keys).agg((F.max("n") + 1).cast("int").alias(out))


def overlap_windows(episodes: DataFrame, cfg: SignalConfig, length: str = "n_samples") -> DataFrame:
    """Hop-aligned windows that overlap the active part of each episode.

    Only the index range that can qualify is generated; column ``length`` is
    the number of samples of the episode's record.
    """
    total = F.col(length)
    nf = F.col("nf")
    end = F.col("win_end")
    first = F.greatest(F.lit(0), F.floor((nf - cfg.win) / cfg.hop))
    last = F.least(F.floor((total - cfg.win) / cfg.hop), F.floor((nf + F.col("_act")) / cfg.hop))
    return (episodes.withColumns({"nf": floor_sample(F.col("event_start"), cfg.t0, cfg.fs),
                                  "_act": active_length(cfg)})
            .where((total >= cfg.win) & (last >= first))
            .select("*", F.explode(F.sequence(first, last)).alias("_k"))
            .withColumn("win_end", (F.col("_k") * cfg.hop + cfg.win).cast("int"))
            .where((end > nf) & (end - cfg.win < nf + F.col("_act")))
            .withColumn("post_ms", (end - nf) / cfg.fs * 1000.0)
            .drop("_k", "_act"))


def hop_windows(episodes: DataFrame, cfg: SignalConfig, length: str = "n_samples",
                incipient_s: float = 0.005) -> DataFrame:
    """Start-indexed windows, active for a fixed time or to the record end (column ``length``)."""
    total = F.col(length)
    nf = F.col("nf")
    dur = F.when(is_incipient(F.col("etype")), int(round(incipient_s * cfg.fs))).otherwise(int(10 * cfg.fs))
    return (episodes.withColumn("nf", half_even_sample(F.col("event_start"), cfg.t0, cfg.fs))
            .where(total >= cfg.win)
            .select("*", F.explode(F.sequence(F.lit(0), F.floor((total - cfg.win) / cfg.hop))).alias("k"))
            .withColumn("win_end", (F.col("k") * cfg.hop + cfg.win).cast("int"))
            .where((F.col("win_end") > nf) & (F.col("k") * cfg.hop < nf + dur))
            .withColumn("tau_ms", (F.col("win_end") - nf) / cfg.fs * 1000.0))


def count_windows(windows: DataFrame, by: list[str], episode: list[str]) -> DataFrame:
    """Windows and episodes per group; episodes are reduced before counting."""
    per_ep = windows.groupBy(*by, *[e for e in episode if e not in by]).agg(F.count(F.lit(1)).alias("_w"))
    return per_ep.groupBy(*by).agg(F.sum("_w").alias("windows"), F.count(F.lit(1)).alias("episodes"))


def window_set_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Windows present in only one of two sets; empty means equal sets."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    return (ka.join(kb, keys, "left_anti").withColumn("side", F.lit("left_only"))
            .unionByName(kb.join(ka, keys, "left_anti").withColumn("side", F.lit("right_only"))))


# --- samples to windows ------------------------------------------------------

def pane_table(samples: DataFrame, part: list[str], aggs: dict[str, Column], cfg: SignalConfig,
               require: Column | None = None) -> DataFrame:
    """One row per (part, pane). ``require`` must be defined on every sample."""
    seen = F.count(F.lit(1)) if require is None else F.count(require)
    return (samples.groupBy(*part, F.floor(F.col("n") / cfg.hop).alias("pane"))
            .agg(*[a.alias(k) for k, a in aggs.items()], seen.alias("_cnt")))


def bound(offset: int) -> str:
    return "CURRENT ROW" if offset == 0 else f"{abs(offset)} {'PRECEDING' if offset < 0 else 'FOLLOWING'}"


ROLLERS = {"sum": "sum({c}) {w}", "max": "max({c}) {w}", "min": "min({c}) {w}", "join": "flatten(collect_list({c}) {w})"}


def roll_panes(panes: DataFrame, part: list[str], specs: dict[str, tuple], cfg: SignalConfig,
               blk: str | None = None, keep_blk: bool = False) -> DataFrame:
    """Roll panes into windows, with the block each belongs to if ``keep_blk``.

    ``specs`` maps an output to (kind, pane column, first, last) with pane
    offsets relative to the last pane. Frames range over pane numbers, not row
    counts, and a window is kept only if all its samples are present.
    """
    # A long record is rolled in bounded runs of panes, never as one group.
    run = blk
    if run is None:
        per = cfg.block_hops
        run = "_run"
        panes = panes.select("*", F.explode(F.sequence(
            F.floor(F.col("pane") / per), F.floor((F.col("pane") + cfg.win_panes - 1) / per))).alias(run))
    by = ", ".join([*part, *([run] if run not in part else [])])

    def over(lo, hi):
        return f"OVER (PARTITION BY {by} ORDER BY pane RANGE BETWEEN {bound(lo)} AND {bound(hi)})"

    out = {k: F.expr(ROLLERS[kind].format(c=c, w=over(lo, hi))) for k, (kind, c, lo, hi) in specs.items()}
    out["_cnt"] = F.expr(f"sum(_cnt) {over(-(cfg.win_panes - 1), 0)}")
    rolled = (panes.withColumns(out).where(F.col("_cnt") == cfg.win)
              .withColumn("win_end", ((F.col("pane") + 1) * cfg.hop).cast("int")))
    rolled = owned_windows(rolled, cfg, blk=run)
    return rolled.select(*[p for p in part if p != blk or keep_blk], "win_end", *specs)


def assign_samples(samples: DataFrame, windows: DataFrame, keys: list[str], cfg: SignalConfig) -> DataFrame:
    """Pair every window with its samples, for ends at arbitrary positions.

    Range membership becomes an equi-join on window-length slots: a window
    touches at most two slots.
    """
    w = windows.withColumn("_s0", F.col("win_end") - cfg.win)
    w = w.select("*", F.explode(F.sequence(
        F.floor(F.col("_s0") / cfg.win), F.floor((F.col("win_end") - 1) / cfg.win))).alias("_slot"))
    s = samples.withColumn("_slot", F.floor(F.col("n") / cfg.win))
    return (s.join(w, [*keys, "_slot"])
            .where((F.col("n") >= F.col("_s0")) & (F.col("n") < F.col("win_end")))
            .drop("_slot", "_s0"))


def dft_terms(n: Column, cfg: SignalConfig) -> tuple[Column, Column]:
    """cos and sin of the fundamental at the global sample index."""
    angle = F.pmod(n, F.lit(cfg.cycle)) * F.lit(2.0 * math.pi / cfg.cycle)
    return F.cos(angle), F.sin(angle)


def dft_sums(cols: list[str], cfg: SignalConfig) -> dict[str, Column]:
    """Per-pane phasor sums, additive because the time reference is absolute."""
    g = 2.0 / cfg.cycle
    out = {}
    for c in cols:
        out[f"{c}_c"] = F.expr(f"sum({c} * _cos) * {g!r}D")
        out[f"{c}_s"] = F.expr(f"sum({c} * _sin) * {-g!r}D")
    return out


def cycle_specs(cols: list[str], cfg: SignalConfig, prefix: str, which: str) -> dict[str, tuple]:
    """Roll specs of the phasors of the last or the first cycle of a window."""
    p = cfg.cycle_panes
    lo, hi = (-(p - 1), 0) if which == "last" else (-(cfg.win_panes - 1), -(cfg.win_panes - p))
    out = {}
    for c in cols:
        out[f"{prefix}{c}_re"] = ("sum", f"{c}_c", lo, hi)
        out[f"{prefix}{c}_im"] = ("sum", f"{c}_s", lo, hi)
    return out


def with_dft_terms(df: DataFrame, cfg: SignalConfig) -> DataFrame:
    c, s = dft_terms(F.col("n"), cfg)
    return df.withColumns({"_cos": c, "_sin": s})


def reference_cycle(samples: DataFrame, starts: DataFrame, keys: list[str], cols: list[str],
                    cfg: SignalConfig, prefix: str = "pre_") -> DataFrame:
    """Phasors of one cycle per start, at column ``pre`` of ``starts``: (keys, pre, phasors).

    The cycle touches at most two cycle-length slots, so the join is on
    (record, slot): a long record neither meets one task nor is read past its
    two slots. A record may have several starts. A start without a complete
    cycle has no row.
    """
    want = starts.select(*keys, "pre").distinct().select("*", F.explode(F.sequence(
        F.floor(F.col("pre") / cfg.cycle), F.floor((F.col("pre") + cfg.cycle - 1) / cfg.cycle))).alias("_slot"))
    hit = (samples.withColumn("_slot", F.floor(F.col("n") / cfg.cycle))
           .join(want, [*keys, "_slot"])
           .where((F.col("n") >= F.col("pre")) & (F.col("n") < F.col("pre") + cfg.cycle)))
    sums = with_dft_terms(hit, cfg).groupBy(*keys, "pre").agg(
        *[a.alias(k) for k, a in dft_sums(cols, cfg).items()], F.count(F.lit(1)).alias("_cnt"))
    out = []
    for c in cols:
        out += [F.col(f"{c}_c").alias(f"{prefix}{c}_re"), F.col(f"{c}_s").alias(f"{prefix}{c}_im")]
    return sums.where(F.col("_cnt") == cfg.cycle).select(*keys, "pre", *out)


def raw_windows(samples: DataFrame, wanted: DataFrame, keys: list[str], cols: list[str],
                cfg: SignalConfig, blk: str | None = None) -> DataFrame:
    """Raw window arrays built from samples: panes first, then their joins.

    No array is longer than a window, whatever the length of the record. Samples move once, by block, and only to blocks that own
    a wanted window; wanted windows travel there, so arrays stay where they are made. ``blk`` names the block column if the
    samples are in halo blocks already.
    """
    rest = [c for c in wanted.columns if c not in keys]
    part = [*keys, blk or "blk"]
    own = (wanted.select(*keys, F.floor((F.col("win_end") - 1) / cfg.block).alias(part[-1]), F.struct(*rest).alias("_w"))
           .groupBy(*part).agg(F.collect_list("_w").alias("_w")))
    rows = samples.select(*part, "n", *cols) if blk else halo_blocks(samples.select(*keys, "n", *cols), cfg)
    rows = rows.join(own.select(*part), part, "left_semi")
    cells = F.sort_array(F.collect_list(F.struct("n", *[F.col(c).cast("float").alias(c) for c in cols])))
    panes = pane_table(rows, part, {"_p": cells}, cfg)
    panes = panes.select(*part, "pane", "_cnt", *[F.col(f"_p.{c}").alias(c) for c in cols])
    specs = {c: ("join", c, -(cfg.win_panes - 1), 0) for c in cols}
    rolled = roll_panes(panes, part, specs, cfg, blk=part[-1], keep_blk=True).withColumnRenamed("win_end", "_end")
    mine = F.filter("_w", lambda w: w["win_end"] == F.col("_end"))
    found = rolled.join(own, part).withColumn("_w", F.explode(mine))
    more = ["win_end", *[c for c in rest if c != "win_end"]]
    return found.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in more], *cols)
