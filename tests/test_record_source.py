"""Record files: written, split, pruned, filtered, and odd ones."""

import pytest
from pyspark.sql import functions as F

from faultspark.operators.signal import CHANNELS
from faultspark.sources import record_source as rs

NAMES = lambda *ends: ",".join(["t"] + [f"g\\pex_MainBus{b}_MainLn{ln}" + (f".{k}" if k else "") for b, ln in ends for k in range(6)])
UNITS = lambda m: ",".join(["s"] + ["Isec:A", "Isec:B", "Isec:C", "Usec:A", "Usec:B", "Usec:C"] * m)


def lines_of(spark, records):
    rows = [(i, n - len(head), text) for i, (head, body) in records.items() for n, text in enumerate(head + body)]
    return spark.createDataFrame(rows, "sim_idx long, n long, value string").repartition(4)


def body(n, m, k=1.0):
    return [",".join(str(v) for v in [1 + i / 800] + [k * (i + 0.125 * j) for j in range(6 * m)]) for i in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rec") / "a b")
    two, one = [NAMES((1, "1-2"), (2, "1-2")), UNITS(2)], [NAMES((3, "4-5A")), UNITS(1)]
    records = {7: (two, body(300, 2)), 12: (one, body(90, 1, 2.0)), 13: (one, []), 14: ([], []), 15: (["x,y", "s,s"], body(3, 1)),
               16: (one, ["1.0,x,2,nan,4", "1.00125,1,2,3,4,5,6", "oops", "1.0025", ""])}
    assert rs.write_records(lines_of(spark, records), path) == 5  # 14 has no line
    rs.register(spark)
    return path


def read(spark, folder, **options):
    r = spark.read.format("records").option("fs", 800)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(folder)


def test_records(spark, folder):
    rows = {(r.sim_idx, r.bus, r.target, r.n): [r[c] for c in CHANNELS] for r in read(spark, folder).collect()}
    assert len(rows) == 300 * 2 + 90 + 3
    assert all(rows[7, b, "MainLn1-2", n] == [n + 0.125 * (6 * (b - 1) + j) for j in range(6)] for b in (1, 2) for n in range(300))
    assert rows[12, 3, "MainLn4-5A", 89] == [2.0 * (89 + 0.125 * j) for j in range(6)]
    assert rows[16, 3, "MainLn4-5A", 0] == [None, 2.0, None, 4.0, None, None]
    assert rows[16, 3, "MainLn4-5A", 2] == [None] * 6


@pytest.mark.parametrize("split", [37, 1000, 100_000])
def test_splits_read_every_line_once(spark, folder, split):
    a = sorted(map(repr, read(spark, folder).collect()))
    assert sorted(map(repr, read(spark, folder, split_bytes=split).collect())) == a


def test_only_what_is_wanted(spark, folder):
    df = read(spark, folder, channels="ib,vc", buses="2").where("sim_idx = 7")
    assert df.columns == ["sim_idx", "bus", "target", "n", "ib", "vc"] and df.count() == 300
    assert df.rdd.getNumPartitions() == 1  # the filter chose one file
    assert read(spark, folder).where(F.col("sim_idx").isin(12, 99)).count() == 90
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Join" not in plan


def test_read_records_query_gives_every_sample(spark, sf):
    from faultspark.plans.catalog import QUERIES

    df = QUERIES["read_records"](spark, sf)
    assert {"sim_idx", "bus", "n", "ia", "ib", "ic", "va", "vb", "vc"} == set(df.columns)
    assert df.groupBy("sim_idx", "bus").count().where("count > 1").count() > 0


def test_whole_records_move_once(spark, sf, monkeypatch, tmp_path):
    """Records written in parts, from samples that move once and as numbers, are the files of ``record_lines``."""
    from faultspark.plans import fixtures as fx
    from faultspark.plans import other_queries as oq

    stored = fx.stored_sig(spark, sf)
    whole = oq.whole_records(fx.two_terminal(spark, sf, stored))
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(whole.collect()) == sorted(oq.record_lines(spark, sf, stored).select("sim_idx", "n", "value").collect())
    rows = sorted(map(repr, oq.read_records(spark, sf).collect()))
    monkeypatch.setattr(fx, "PART_ROWS", 2000)
    assert len(fx.sample_parts(spark, sf, "line")) > 2
    assert sorted(map(repr, oq.read_records(spark, sf).collect())) == rows


def test_small_files_share_a_task(spark, folder):
    assert read(spark, folder).rdd.getNumPartitions() == 1
