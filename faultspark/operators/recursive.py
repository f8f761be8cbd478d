"""Recursive second-order filters on samples, by composing states over blocks.

The filter's state is a pair s, advanced by s' = A s + B x. Over a block of L samples that is s' = A^L s + c, where c is a sum of
the samples with fixed weights A^(L-1-k) B: an ordinary aggregate, combined before it is shuffled. These maps compose, so a
group of ``fan`` blocks is again such a map. The states at the starts of groups come from an ordered pass over groups, those of
blocks from an ordered pass within each group, and then every block is run from its own start, all blocks in parallel. No task
sees more of a record than one block of samples, one group of block sums, or the sums of its groups one by one.

Samples are shuffled once, on (record, block); what else moves is two numbers per channel and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a block, and blocks of a group.
BLOCK, FAN = 512, 512


def transition(b: list[float], a: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """A and B of the filter with numerator b and denominator a (a[0] = 1)."""
    return np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])


def powers(m: np.ndarray, n: int) -> np.ndarray:
    """The n first powers of a matrix, from the zeroth."""
    out = np.empty((n, *m.shape))
    out[0] = np.eye(len(m))
    for k in range(1, n):
        out[k] = m @ out[k - 1]
    return out


def _weight(values: np.ndarray, at: Column) -> Column:
    """Element of a constant array."""
    return F.element_at(F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"), at + 1)


def _groups(batches: Iterator[pa.RecordBatch], marker: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds whole groups; a group begins at a row whose ``marker`` is -1."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        starts = np.flatnonzero(b.column(marker).to_numpy(zero_copy_only=False) == -1)
        if not len(starts):
            held.append(b)
            continue
        cut = int(starts[-1])
        if held or cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; rows that are null are left out."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _ordered(rows: DataFrame, keys: list[str], marker: str, schema: str, step: np.ndarray, full: int, width: int) -> DataFrame:
    """State at the start of each row of a group, in the order of ``marker``; a row at -1 holds the state that the group starts in.

    Every row advances the state by ``step`` and its own ``c``. Rows after a gap, or after one that lacks samples, have no state (NaN).
    """
    names = [*keys, marker]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, whole = np.zeros((width, 2)), -1, True
        for b in batches:
            at = b.column(marker).to_numpy(zero_copy_only=False)
            count = b.column("cnt").to_numpy(zero_copy_only=False)
            c = _matrix(b.column("c"), 2 * width).reshape(-1, width, 2)
            out = np.empty((len(at), 2 * width))
            for i in range(len(at)):
                if at[i] == -1:
                    state, last, whole = c[i], -1, True
                    continue
                if at[i] != last + 1 or not whole:
                    state = np.full_like(state, np.nan)
                out[i] = state.ravel()
                state, last, whole = state @ step.T + c[i], at[i], count[i] == full
            keep = pa.array(at != -1)
            made = pa.RecordBatch.from_arrays([b.column(n) for n in names] + [_lists(out)], names=[*names, "s"])
            yield made.filter(keep)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, marker)
    return dealt.mapInArrow(run, schema)


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel()))


def recursive_filter(samples: DataFrame, keys: list[str], channels: list[str], b: list[float], a: list[float], cycle: int, pad: int,
                     block: int = BLOCK, fan: int = FAN, carry: list[str] | None = None) -> DataFrame:
    """``samples`` (keys, n, channels) with every channel filtered, started from steady state: the first cycle is thought to
    be repeated before the record for ``pad`` samples (whole cycles). Columns named in ``carry`` stay as they are.

    (keys, n) is unique and n runs from 0. An undefined sample, or one that is missing, leaves its channel (the record) undefined
    from there on, and so does a first cycle that is not complete. Samples without n are dropped, and so are other columns.
    """
    carry = carry or []
    block = max(block, cycle)
    width = len(channels)
    state, drive = transition(b, a)
    up = powers(state, max(block, cycle) + 1)
    within = up[:block][::-1] @ drive
    initial = up[:cycle][::-1] @ drive
    over_block = up[block]
    groups = powers(over_block, fan + 1)
    whole_cycle = up[cycle]
    steady = powers(whole_cycle, max(1, pad // cycle))[:pad // cycle].sum(axis=0)
    kinds = dict(samples.dtypes)
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    x = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in channels]
    rows = samples.where("n is not null").select(*keys, F.col("n").cast("long").alias("n"), *x, *carry)
    rows = rows.withColumns({"_blk": F.floor(F.col("n") / block), "_k": F.pmod("n", F.lit(block)).cast("int")})
    first = F.col("n") < cycle
    # Weights become columns once, so that the sums of all channels share them.
    weighted = rows.withColumns({f"_w{j}": _weight(within[:, j], F.col("_k")) for j in (0, 1)}
                                | {f"_v{j}": F.when(first, _weight(initial[:, j], F.col("n").cast("int"))) for j in (0, 1)})
    sums = {}
    for i, c in enumerate(channels):
        for j in (0, 1):
            sums[f"c{i}_{j}"] = F.sum(F.col(c) * F.col(f"_w{j}"))
            sums[f"p{i}_{j}"] = F.sum(F.when(first, F.col(c) * F.col(f"_v{j}")))
    blocks = weighted.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("cnt"), F.count_if(first).alias("pc"), *[v.alias(k) for k, v in sums.items()])
    blocks = blocks.withColumns({"_grp": F.floor(F.col("_blk") / fan), "_in": F.pmod("_blk", F.lit(fan)).cast("int")})

    def composed(i: int, j: int) -> Column:
        """Part of the group's sum: every block's sum advanced by the blocks after it."""
        return F.sum(F.col(f"c{i}_0") * F.col(f"_a{j}0") + F.col(f"c{i}_1") * F.col(f"_a{j}1"))

    ahead = groups[:fan][::-1]
    advanced = blocks.withColumns({f"_a{j}{k}": _weight(ahead[:, j, k], F.col("_in")) for j in (0, 1) for k in (0, 1)})
    totals = advanced.groupBy(*keys, "_grp").agg(F.sum("cnt").alias("cnt"), F.array(*[composed(i, j) for i in range(width) for j in (0, 1)]).alias("c"))
    complete = F.coalesce(F.sum("pc") == cycle, F.lit(False))

    def settled(i: int, j: int) -> Column:
        p0, p1 = (F.coalesce(F.sum(f"p{i}_{k}"), F.lit(0.0)) for k in (0, 1))
        return F.when(complete, p0 * float(steady[j, 0]) + p1 * float(steady[j, 1])).otherwise(float("nan"))

    starts = blocks.groupBy(*keys).agg(F.lit(-1).cast("long").alias("_grp"), F.lit(0).cast("long").alias("cnt"),
                                       F.array(*[settled(i, j) for i in range(width) for j in (0, 1)]).alias("c"))
    at_groups = _ordered(starts.unionByName(totals), keys, "_grp", f"{key_schema}, _grp long, s array<double>", groups[fan], block * fan, width)
    inner = blocks.select(*keys, "_grp", F.col("_in").cast("long").alias("_in"), "cnt", F.array(*[f"c{i}_{j}" for i in range(width) for j in (0, 1)]).alias("c"))
    seeds = at_groups.select(*keys, "_grp", F.lit(-1).cast("long").alias("_in"), F.lit(0).cast("long").alias("cnt"), F.col("s").alias("c"))
    at_blocks = _ordered(inner.unionByName(seeds), [*keys, "_grp"], "_in", f"{key_schema}, _grp long, _in long, s array<double>", over_block, block, width)
    at_blocks = at_blocks.select(*keys, (F.col("_grp") * fan + F.col("_in")).alias("_blk"), F.lit(-1).cast("long").alias("n"), "s", F.lit(None).cast("array<double>").alias("x"),
                                 *[F.lit(None).cast(kinds[c]).alias(c) for c in carry])
    values = rows.select(*keys, "_blk", "n", F.lit(None).cast("array<double>").alias("s"), F.array(*channels).alias("x"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, "n"):
            n = b.column("n").to_numpy(zero_copy_only=False)
            is_state = n == -1
            s = _matrix(b.column("s"), 2 * width).reshape(-1, width, 2)
            of = np.cumsum(is_state) - 1
            own, k = of[~is_state], n[~is_state] % block
            data = np.full((block, len(s), width), np.nan)
            data[k, own] = _matrix(b.column("x"), width)
            s1, s2 = s[:, :, 0].copy(), s[:, :, 1].copy()
            for i in range(int(k.max(initial=-1)) + 1):
                value = data[i]
                y = b0 * value + s1
                s1 = b1 * value - a1 * y + s2
                s2 = b2 * value - a2 * y
                data[i] = y
            y = data[k, own]
            kept = b.filter(pa.array(~is_state))
            yield pa.RecordBatch.from_arrays(
                [kept.column(c) for c in [*keys, "n"]] + [pa.array(y[:, i], mask=np.isnan(y[:, i])) for i in range(width)] + [kept.column(c) for c in carry],
                names=[*keys, "n", *channels, *carry])

    b0, b1, b2 = b
    _, a1, a2 = a
    dealt = values.unionByName(at_blocks).repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", "n")
    schema = f"{key_schema}, n long, " + ", ".join([f"`{c}` double" for c in channels] + [f"`{c}` {kinds[c]}" for c in carry])
    return dealt.mapInArrow(run, schema).withColumn("n", F.col("n").cast(kinds["n"]))
