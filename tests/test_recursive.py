"""Block-wise recursive filters against the plain recurrence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultspark.operators import arrays, recursive


def plain(x, b, a, cycle, pad):
    z = np.concatenate([np.tile(x[:cycle], pad // cycle), x])
    y, s1, s2 = np.zeros(len(z)), 0.0, 0.0
    for n, v in enumerate(z):
        y[n] = b[0] * v + s1
        s1 = b[1] * v - a[1] * y[n] + s2
        s2 = b[2] * v - a[2] * y[n]
    return y[pad // cycle * cycle:]


@pytest.mark.parametrize("block,fan", [(16, 2), (16, 3), (40, 4), (512, 512)])
def test_blocks_compose(spark, block, fan):
    rng = np.random.default_rng(block)
    records = {1: rng.normal(size=(700, 2)), 2: rng.normal(size=(16, 2)), 3: rng.normal(size=(97, 2)), None: rng.normal(size=(64, 2))}
    rows = [(r, n, float(x), float(y), 0) for r, v in records.items() for n, (x, y) in enumerate(v)]
    df = spark.createDataFrame(rows, "rec long, n int, ia double, ib double, s int").repartition(7)
    for b, a in (arrays.resonant2(0.015, 50.0, 800.0), arrays.butterworth2(160.0, 800.0)):
        out = recursive.recursive_filter(df, ["rec"], ["ia", "ib"], b, a, 16, 160, block, fan)
        assert out.dtypes == [("rec", "bigint"), ("n", "int"), ("ia", "double"), ("ib", "double")]
        got = {(r.rec, r.n): (r.ia, r.ib) for r in out.collect()}
        assert len(got) == len(rows)
        for r, v in records.items():
            for i in (0, 1):
                want = plain(v[:, i], b, a, 16, 160)
                assert max(abs(got[r, n][i] - w) for n, w in enumerate(want)) < 1e-9


def test_undefined_samples(spark):
    b, a = arrays.butterworth2(160.0, 800.0)
    x = np.sin(np.arange(100) / 3.0)
    rows = [(0, n, float(v), float(v) if n != 60 else None) for n, v in enumerate(x)]  # undefined in one channel
    rows += [(1, n, float(v), float(v)) for n, v in enumerate(x) if n != 47]  # missing at the end of a block
    rows += [(2, n, 1.0, float("nan") if n == 3 else 1.0) for n in range(9)]  # no whole cycle
    rows += [(3, n, 1.0, 1.0) for n in range(5, 100)]  # no start
    rows += [(4, n, float(v), float(v)) for n, v in enumerate(x) if not 16 <= n < 32]  # a whole block missing
    rows += [(5, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "rec long, n long, ia double, ib double")
    got = {(r.rec, r.n): (r.ia, r.ib) for r in recursive.recursive_filter(df, ["rec"], ["ia", "ib"], b, a, 16, 160, 16, 2).collect()}
    want = plain(x, b, a, 16, 160)
    assert len(got) == len(rows) - 1
    for (rec, n), (p, q) in got.items():
        fine = {0: (True, n < 60), 1: (n < 47,) * 2, 2: (False, False), 3: (False, False), 4: (n < 16,) * 2}[rec]
        assert [p is not None, q is not None] == list(fine)
        assert all(v is None or abs(v - want[n]) < 1e-9 for v in (p, q))


def test_no_records(spark):
    df = spark.createDataFrame([], "rec long, n long, ia double")
    assert recursive.recursive_filter(df, ["rec"], ["ia"], *arrays.butterworth2(160.0, 800.0), 16, 160).count() == 0


def test_samples_move_once(spark):
    """One exchange carries samples; the others carry sums of blocks."""
    df = spark.range(4000).select((F.col("id") % 4).alias("rec"), F.floor(F.col("id") / 4).alias("n"), F.rand(1).alias("ia"))
    out = recursive.recursive_filter(df, ["rec"], ["ia"], *arrays.butterworth2(160.0, 800.0), 16, 160, 64, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 3 and "CartesianProduct" not in plan and "NestedLoop" not in plan
