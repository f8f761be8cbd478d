"""Observed checks of written tables and bucketed tables."""

import pytest
from pyspark.sql import functions as F

from faultspark.config import COMPACT as CFG
from faultspark.operators import joins, signal
from faultspark.operators.blocks import halo_blocks
from faultspark.sources import buckets, observe


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checks_while_writing(spark, tmp_path):
    rows = spark.range(1000).select(F.lit(1).alias("rec"), F.col("id").cast("int").alias("n"), F.when(F.col("id") % 10 != 0, 1.0).alias("ia"))
    found = observe.write_checked(rows, str(tmp_path / "a"), observe.sample_checks(["ia"]))
    assert found == {"rows": 1000, "records": 1, "before_start": 0, "undefined": 100}
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1000
    with pytest.raises(ValueError, match="undefined 100"):
        observe.write_checked(rows, str(tmp_path / "b"), observe.sample_checks(["ia"]), {"undefined": 99, "rows": 1000})
    assert observe.write_checked(rows.where("n < 0"), str(tmp_path / "c"), observe.sample_checks(["ia"]))["rows"] == 0
    rules = spark.createDataFrame([("gaps",), ("gaps",), (None,)], "rule string")
    assert observe.write_checked(rules, str(tmp_path / "d"), observe.rule_counts(["gaps", "span"])) == {"gaps": 2, "span": 0}


def test_joins_and_pairs_without_shuffle(spark, tmp_path):
    key = ["sim_idx", "win"]
    base = spark.range(400).select((F.col("id") % 40).alias("sim_idx"), (F.col("id") / 40).cast("int").alias("win"), F.rand(1).alias("x"))
    stored = [buckets.write_bucketed(base.select(*key, F.col("x").alias(f"x{k}")), str(tmp_path / f"p{k}"), key, 4) for k in range(3)]
    term = spark.range(300).select(F.lit(1).alias("line"), (F.col("id") / 2).cast("int").alias("n"), (F.col("id") % 2).cast("int").alias("term"), F.rand(2).alias("ia"))
    halo = buckets.write_bucketed(halo_blocks(term, CFG), str(tmp_path / "halo"), ["line", "blk"], 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = joins.assemble(stored[0], stored[1:], key)
        assert "Exchange" not in plan(whole) and "SortMergeJoin" in plan(whole)
        assert whole.count() == 400 and whole.where("x0 = x1 and x1 = x2").count() == 400
        pairs = signal.pair_terminals(halo, ["line"], ["ia"])
        assert "Exchange" not in plan(pairs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    again = base.unionByName(base.limit(1)).select(*key, F.col("x").alias("x9"))
    twice = buckets.write_bucketed(again, str(tmp_path / "twice"), key, 4)
    with pytest.raises(Exception, match="not unique"):
        joins.assemble(stored[0], [twice], key).collect()
