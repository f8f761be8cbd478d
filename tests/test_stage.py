"""Stored steps: rows are made once, no shuffle files stay behind, and samples are numbered once for queries that read them often."""

import glob
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from faultspark.plans import fixtures as fx
from faultspark.plans import other_queries
from faultspark.sources import buckets
from faultspark.sources.stage import CLEANUP, discard, materialise, parts, shared_path


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(1000).select("id", (F.col("id") / 3).alias("x"), F.array("id").alias("a"))
    stored = materialise(rows.mapInArrow(run, rows.schema))
    assert sorted(stored.collect()) == sorted(rows.collect()) and stored.count() == 1000
    assert made.value == 1000


def test_shuffle_files_are_removed(spark):
    local = spark.sparkContext.getConf().get("spark.local.dir")
    files = lambda: set(glob.glob(f"{local}/**/shuffle_*.data", recursive=True))
    before, setting = files(), spark.conf.get(CLEANUP)
    stored = materialise(spark.range(20_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(CLEANUP) == setting
    assert {r.k: r["count"] for r in stored.collect()} == {k: len(range(k, 20_000, 7)) for k in range(7)}


@pytest.mark.parametrize("name", ["sync_sweep", "observed_checks"])
def test_samples_are_numbered_once(spark, sf, name, monkeypatch):
    calls, whole = [], fx.number_rows
    monkeypatch.setattr(fx, "number_rows", lambda *a, **k: calls.append(1) or whole(*a, **k))
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "l_orderkey" not in plan


def test_buckets_grow_in_number():
    assert [buckets.bucket_count(n) for n in (0, 600_000)] == [8, 8]
    assert buckets.bucket_count(216_000_000) >= 27 * 8


@pytest.mark.parametrize("name", ["filtered_scenarios", "regenerate_and_compare"])
def test_parts_give_the_whole_result(spark, sf, name, monkeypatch):
    """Steps are stored part by part, so no job holds the shuffle files of all samples; the result is that of one part."""
    kept, whole = [], other_queries.materialise
    monkeypatch.setattr(other_queries, "materialise", lambda *a: kept.append(whole(*a)) or kept[-1])
    rows = sorted(map(repr, entry.queries()[name](spark, sf).collect()))
    once = len(kept)
    monkeypatch.setattr(fx, "PART_ROWS", 3500)
    df = entry.queries()[name](spark, sf)
    assert len(fx.sample_parts(spark, sf, "rec")) == 2 and len(kept) - once == 2 * once
    if name == "filtered_scenarios":  # estimates and flags of a chain are stored, not joined in one job with those of all others
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, df.collect())) == rows


def test_parts_hold_every_row_once(spark):
    keys = spark.range(1000).selectExpr("if(id = 7, null, id) as k")
    found = [keys.where(p).collect() for p in parts(1000, "k", 300)]
    assert len(found) == 4 and sorted(map(repr, sum(found, []))) == sorted(map(repr, keys.collect()))


def test_discard(spark):
    path = shared_path(spark, "gone")
    assert materialise(spark.range(3), path).count() == 3
    discard(spark, path)
    assert not glob.glob(path.removeprefix("file:"))
