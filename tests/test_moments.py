"""Sums over ranges against sums over the samples themselves."""

import random

import pytest
from pyspark.sql import functions as F

from faultspark.operators.moments import range_sums


def test_ranges_of_any_length(spark):
    rng = random.Random(3)
    samples = [(r, n, None if rng.random() < 0.1 else rng.uniform(-1, 1) + 1e6 * (n < 40)) for r in (1, 2) for n in range(200) if r == 1 or n % 7]
    ranges = sorted({(r, a, a + rng.choice([1, 2, 9, 10, 11, 75])) for r in (1, 2, 3) for a in (rng.randrange(0, 210) for _ in range(60))})
    ranges += [(1, 5, 5), (1, 9, 4), (1, 10, 20), (1, 0, 10), (1, 0, 200)]  # empty, reversed, exactly a block, the whole record
    s = spark.createDataFrame(samples, "rec int, n int, x double").repartition(5)
    g = spark.createDataFrame(sorted(set(ranges)), "rec int, lo int, hi int")
    got = range_sums(s, g, ["rec"], {"x": F.col("x"), "one": F.lit(1.0)}, 10, "lo", "hi", {"x": "xt", "one": "t"}, {"one": "tt"}, 2.0)
    found = {(r.rec, r.lo, r.hi): r for r in got.collect()}
    want = {}
    for r, lo, hi in set(ranges):
        inside = [(n, x) for k, n, x in samples if k == r and lo <= n < hi]
        if inside:
            want[r, lo, hi] = (len(inside), sum(x or 0 for _, x in inside), sum((x or 0) * (n - hi) / 2 for n, x in inside),
                               sum((n - hi) / 2 for n, _ in inside), sum(((n - hi) / 2) ** 2 for n, _ in inside))
    assert set(found) == set(want) and len(want) > 50
    for k, v in want.items():
        r = found[k]
        assert (r._cnt, r.x, r.xt, r.t, r.tt) == pytest.approx(v, rel=1e-9, abs=1e-6)


def test_late_ranges_have_no_error_of_early_samples(spark):
    """A huge early sample is in another block, so it leaves nothing behind."""
    s = spark.range(100).select(F.lit(1).alias("rec"), F.col("id").cast("int").alias("n"), F.when(F.col("id") == 0, 1e18).otherwise(0.1).alias("x"))
    g = spark.createDataFrame([(1, 20, 45)], "rec int, lo int, hi int")
    assert range_sums(s, g, ["rec"], {"x": F.col("x")}, 20, "lo", "hi").first().x == pytest.approx(2.5, abs=1e-12)


def test_one_shuffle_of_samples(spark):
    s = spark.range(100).select(F.lit(1).alias("rec"), F.col("id").cast("int").alias("n"), F.rand(1).alias("x"))
    g = spark.createDataFrame([(1, 20, 45)], "rec int, lo int, hi int")
    plan = range_sums(s, g, ["rec"], {"x": F.col("x")}, 20, "lo", "hi")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Generate inline" in plan


def test_empty_tables(spark):
    s = spark.createDataFrame([], "rec int, n int, x double")
    g = spark.createDataFrame([(1, 20, 45)], "rec int, lo int, hi int")
    assert range_sums(s, g, ["rec"], {"x": F.col("x")}, 20, "lo", "hi").count() == 0
    assert range_sums(s, g.where("rec = 2"), ["rec"], {"x": F.col("x")}, 20, "lo", "hi").count() == 0
