"""Registered queries against their SQL on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck

CORE = ["td_scored", "derivative_quadratic", "episode_tokens", "classical_estimates", "staged_locator", "exceed_flags",
        "identify_impedance", "summary", "time_bin_report", "rho_bins_left", "error_ecdf", "per_time_curve", "assemble",
        "compare_tables", "fingerprint", "bootstrap_ci", "grouped_split", "read_records", "recheck_estimate",
        "filter_resonant", "sliding_ratio", "orient_local"]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else CORE)
def test_query(spark, sf, con, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, sf).count() > 0
    else:
        assert compare(spark, con, sf, fn, sql) is None


def test_entry_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["line", "n", "mae", "worst"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, sf, tmp_path):
    from faultspark.streaming import hop

    src = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    args = (["event_type"], "ts", F.col("value") - 10, F.col("value") + 1, "30 hours", "6 hours")
    live = hop.sliding_ratio(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), *args, watermark="60 days")
    q = (live.writeStream.outputMode("complete").format("memory").queryName("hops")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    a = {(r.event_type, r.win_end): round(r.est, 9) for r in spark.table("hops").collect()}
    b = {(r.event_type, r.win_end): round(r.est, 9) for r in hop.sliding_ratio(src, *args).collect()}
    assert a == b and len(a) > 10
