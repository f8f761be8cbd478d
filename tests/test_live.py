"""Live samples: state carried over micro-batches gives the windows of the whole record."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultspark.config import COMPACT as CFG
from faultspark.operators import two_ended
from faultspark.operators.signal import CHANNELS
from faultspark.streaming import live


def record(n, seed):
    return np.random.default_rng(seed).normal(size=(n, 2, 6))


def whole(x):
    state = live.LineState(params=(0.4, 1.3))
    for n in range(len(x)):
        for e in (0, 1):
            state.add(e, n, x[n, e])
    return dict(state.advance(CFG, True))


@pytest.mark.parametrize("seed", range(6))
def test_any_order_in_any_batches(seed):
    x, rng = record(173, seed), random.Random(seed)
    rows = sorted(((n, e) for n in range(173) for e in (0, 1)), key=lambda r: r[0] + rng.random() * 30 * (seed % 3))
    state, found = live.LineState(params=(0.4, 1.3)), {}
    while rows:
        k = rng.randint(1, 25)
        for n, e in rows[:k]:
            state.add(e, n, x[n, e])
        rows = rows[k:]
        found |= dict(state.advance(CFG, False))
        assert len(state.kept) <= 45 + 2 * CFG.fir_half + 25 and len(state.panes) <= CFG.win_panes + 7
    state.add(0, 5, x[5, 0])
    assert state.late == 1
    found |= dict(state.advance(CFG, True))
    want = whole(x)
    assert list(want) == list(range(40, 174, 4)) and set(found) == set(want)
    assert max(abs(found[k] - want[k]) for k in want) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    rows = [(line, e, n, *map(float, x)) for line, size in ((1, 150), (2, 97), (3, 8), (4, 60)) for n, both in enumerate(record(size, line)) for e, x in enumerate(both)]
    names = ["line", "term", "n", *CHANNELS]
    df = spark.createDataFrame(rows, "line long, term int, n int, " + ", ".join(f"{c} double" for c in CHANNELS))
    params = spark.createDataFrame([(k, 0.3 + k / 10, 1.0 + k / 5, 0.9, 3.0) for k in (1, 2, 3)], "line long, z1r double, z1x double, z0r double, z0x double")
    want = {(r.line, r.win_end): r.td_est for r in two_ended.td_estimate(df, params, ["line"], CFG).collect()}
    timed = df.join(params.select("line", "z1r", "z1x"), "line", "left").withColumn("ts", F.timestamp_seconds(F.col("n") / CFG.fs + 1_700_000_000))
    folder = str(tmp_path / "in")
    for part in (2, 0, 1):  # chunks out of order
        timed.where((F.floor(F.col("n") / 30) % 3) == part).coalesce(1).write.mode("append").parquet(folder)
    timed.where("line = 1 and n in (3, 4)").coalesce(1).write.mode("append").parquet(folder)  # again: four late samples
    closing = timed.where("line = 4 and n = 0").withColumns({"line": F.lit(-1).cast("long"), "ts": F.col("ts") + F.expr("interval 1 hour")})
    closing.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (live.td_estimate(stream, "line", "ts", CFG).writeStream.format("memory").queryName("live_td").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    rows = spark.table("live_td").collect()
    got = {(r.line, r.win_end): r.td_est for r in rows if r.win_end is not None}
    assert set(got) == set(want) and len(rows) - len(got) <= 2 and len(want) > 40
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert max(r.late for r in rows if r.line == 1) == 4 and max(r.late for r in rows if r.line == 2) == 0


@pytest.mark.parametrize("seed", range(4))
def test_batches_at_once_equal_rows_one_by_one(seed):
    x, rng = record(121, seed), np.random.default_rng(seed)
    n = np.concatenate([np.repeat(np.arange(121), 2), rng.integers(-2, 125, 40)])
    end = np.concatenate([np.tile([0, 1], 121), rng.integers(-1, 3, 40)])
    values = np.array([x[k, e] if 0 <= k < 121 and e in (0, 1) else np.ones(6) for k, e in zip(n, end)])
    values[-5:, 2] = np.nan
    near = np.argsort(n + rng.random(len(n)) * 40, kind="stable")
    n, end, values = n[near], end[near], values[near]
    one, all_, found = live.LineState(params=(0.4, 1.3)), live.LineState(params=(0.4, 1.3)), []
    for lo in range(0, len(n), 37):
        for k in range(lo, min(lo + 37, len(n))):
            one.add(end[k], n[k], values[k])
        all_.add_all(end[lo:lo + 37], n[lo:lo + 37], values[lo:lo + 37])
        assert one.late == all_.late
        a, b = one.advance(CFG, False), all_.advance(CFG, False)
        assert a == b
        found += b
    found += all_.advance(CFG, True)
    want = whole(x)
    got = dict(found)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want if k <= 110) and all_.late > 0
