"""Halo blocks: the partitioning of all sample-level work.

Every sample is sent to the block that owns it and to the neighbours that need
it as context, so that derivatives, lags, panes and windows of a block are
computed inside one task after a single shuffle on (record, block). A record of
any length is spread over many tasks; the overlap costs (lead + trail) / block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.config import SignalConfig


def halo_blocks(samples: DataFrame, cfg: SignalConfig, n: str = "n", out: str = "blk") -> DataFrame:
    first = F.greatest(F.lit(0), F.floor((F.col(n) - cfg.trail) / cfg.block))
    last = F.floor((F.col(n) + cfg.lead) / cfg.block)
    return samples.select("*", F.explode(F.sequence(first, last)).alias(out))


def owned_samples(df: DataFrame, cfg: SignalConfig, n: str = "n", blk: str = "blk") -> DataFrame:
    return df.where(F.floor(F.col(n) / cfg.block) == F.col(blk))


def owned_windows(df: DataFrame, cfg: SignalConfig, end: str = "win_end", blk: str = "blk") -> DataFrame:
    """Keep the windows whose last sample the block owns."""
    return df.where(F.floor((F.col(end) - 1) / cfg.block) == F.col(blk))


def wanted_blocks(blocked: DataFrame, wanted: DataFrame, keys: list[str], cfg: SignalConfig,
                  end: str = "win_end", blk: str = "blk") -> DataFrame:
    """Keep only blocks that own a wanted window.

    The join key is the block key, so beyond the broadcast threshold it needs
    no shuffle besides the one the blocks need anyway.
    """
    own = wanted.select(*keys, F.floor((F.col(end) - 1) / cfg.block).alias(blk)).distinct()
    return blocked.join(own, [*keys, blk], "left_semi")


def block_params(wanted: DataFrame, params: DataFrame, keys: list[str], cfg: SignalConfig,
                 end: str = "win_end", blk: str = "blk") -> DataFrame:
    """Parameters of every block that owns a wanted window: they meet samples where blocks lie, however many records there are."""
    own = wanted.select(*keys, F.floor((F.col(end) - 1) / cfg.block).alias(blk)).distinct()
    return own.join(params, keys)


def touched_samples(samples: DataFrame, wanted: DataFrame, keys: list[str], cfg: SignalConfig,
                    n: str = "n", end: str = "win_end") -> DataFrame:
    """Keep only samples in the block-length slots that wanted windows touch."""
    slots = wanted.select(*keys, F.explode(F.sequence(
        F.floor((F.col(end) - cfg.win) / cfg.block), F.floor((F.col(end) - 1) / cfg.block))).alias("_slot")).distinct()
    return samples.withColumn("_slot", F.floor(F.col(n) / cfg.block)).join(slots, [*keys, "_slot"], "left_semi").drop("_slot")
