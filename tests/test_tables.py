import numpy as np
import pytest
from pyspark.sql import functions as F

from faultspark.config import SignalConfig
from faultspark.functions import draws, scalar
from faultspark.operators import arrays, joins, numbering, quality, report, resample
from faultspark.sources import records, sinks, tables


def skewed(spark, n=3000, seed=1):
    """One key holds a third of the rows; values repeat."""
    rng = np.random.default_rng(seed)
    key = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, n))
    x = np.round(rng.normal(size=n) * 10, 1)
    return key, x, spark.createDataFrame([(int(k), float(v), i) for i, (k, v) in enumerate(zip(key, x))], "k int, x double, i int")


def test_number_rows_on_a_hot_key(spark):
    key, x, df = skewed(spark)
    out = numbering.number_rows(df, ["k"], ["x", "i"], numbering.magnitude_bucket(F.col("x"), 8))
    got = {(r.k, r.i): r.n for r in out.collect()}
    assert len(got) == len(key)
    for k in set(key):
        idx = np.flatnonzero(key == k)
        order = idx[np.lexsort((idx, x[idx]))]
        assert [got[(k, i)] for i in order] == list(range(len(idx)))


def test_quantiles_match_numpy(spark):
    key, x, df = skewed(spark)
    out = numbering.quantiles(df, ["k"], "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}).collect()
    assert len(out) == len(set(key))
    for r in out:
        want = np.percentile(x[key == r.k], [0, 25, 50, 95, 100])
        assert [r.a, r.b, r.c, r.d, r.e] == pytest.approx(list(want), abs=1e-12)
    g = numbering.quantiles(df, [], "x", {"m": 0.5}).first()
    assert g.m == pytest.approx(np.median(x))


def test_ecdf(spark):
    key, x, df = skewed(spark)
    rows = numbering.ecdf(df, ["k"], "x").where("k = 0").collect()
    v = x[key == 0]
    assert len(rows) == len(set(v))
    for r in rows:
        assert r.ecdf == pytest.approx((v <= r.x).mean())


def test_one_to_one_join_rejects_repeats(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, a double")
    b = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, b double")
    assert joins.join_one_to_one(a, a.withColumnRenamed("a", "c"), ["k"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        joins.join_one_to_one(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="no match"):
        joins.join_complete(a, b.limit(1), ["k"], ["b"]).collect()
    assert joins.overlap(a, b, ["k"]).count() == 1


def test_undefined_values(spark):
    df = spark.sql("select cast(x as double) x from values ('NaN'), ('Infinity'), ('0.3'), ('-2'), ('7'), (null) t(x)")
    got = [r[0] for r in df.select(scalar.clip(scalar.defined(F.col("x")), 0, 1)).collect()]
    assert got == [None, None, 0.3, 0.0, 1.0, None]
    e = [r[0] for r in df.select(scalar.score(scalar.defined(F.col("x")), F.lit(0.5))).collect()]
    assert e == pytest.approx([0, 0, 20, 50, 50, 0])


def test_bin_edges(spark):
    df = spark.sql("select explode(array(0D, 0.3D, 1D, 17.5D)) x")
    got = [tuple(r) for r in df.select(scalar.bucketise(F.col("x"), [0, 0.3, 1]), scalar.bucketise(F.col("x"), [0, 0.3, 1], closed="left")).collect()]
    assert got == [(None, "[0, 0.3)"), ("(0, 0.3]", "[0.3, 1)"), ("(0.3, 1]", None), (None, None)]


def test_argmin_first_wins_ties(spark):
    df = spark.sql("select 2D a, 1D b, 1D c, cast(null as double) d")
    assert df.select(scalar.argmin_columns(["a", "b", "c", "d"])).first()[0] == "b"


def test_bootstrap_counts_are_multinomial():
    n, b, size = 1000, 40, 64
    per = np.stack([resample._bucket_counts(n, k, b, 5, size) for k in range(-(-n // size))])
    assert (per.sum(0) == n).all() and (per >= 0).all()
    share = per.mean(1) / n
    assert share[:-1] == pytest.approx(np.full(len(share) - 1, size / n), rel=0.15)


def test_bootstrap_interval_against_numpy(spark):
    rng = np.random.default_rng(2)
    ep = np.repeat(np.arange(300), 4)
    e = rng.gamma(2, 3, 300)[ep] + rng.normal(size=1200) ** 2
    df = spark.createDataFrame([(int(a), float(v)) for a, v in zip(ep, e)], "ep long, e double")
    s, w = np.bincount(ep, e), np.bincount(ep)
    picks = rng.integers(0, 300, (4000, 300))
    m = s[picks].sum(1) / w[picks].sum(1)
    want = np.percentile(m, [2.5, 97.5])
    for how in ("multinomial", "hash"):
        r = resample.bootstrap_ci(df, [], "ep", F.col("e"), 400, 1, how).first()
        assert r.mae == pytest.approx(e.mean())
        assert [r.ci_lo, r.ci_hi] == pytest.approx(list(want), abs=0.2)
    r = resample.paired_reduction(df, [], "ep", F.col("e") * 0.5, F.col("e"), 50).first()
    assert r.reduction == pytest.approx(50) and r.ci_lo == pytest.approx(50) and r.ci_hi == pytest.approx(50)


def test_grouped_split_keeps_episodes_whole(spark):
    df = spark.range(1000).select((F.col("id") % 91).alias("ep"))
    out = resample.grouped_split(df, ["ep"], 0.3, 4).groupBy("ep").agg(F.countDistinct("split").alias("k"), F.first("split").alias("s")).collect()
    assert all(r.k == 1 for r in out) and sum(r.s == "test" for r in out) == round(0.3 * 91)


def test_filters_keep_the_fundamental():
    b, a = arrays.resonant2(0.015, 50.0, 9600.0)
    assert abs(arrays.gain_at(b, a, 50.0, 9600.0) - 1) < 0.01
    b, a = arrays.butterworth2(2000.0, 9600.0)
    assert abs(arrays.gain_at(b, a, 0.0, 9600.0)) == pytest.approx(1)
    assert abs(arrays.gain_at(b, a, 2000.0, 9600.0)) == pytest.approx(2 ** -0.5)


def test_filter_and_delay_on_arrays(spark):
    t = np.arange(64)
    x = np.cos(2 * np.pi * t / 16)
    df = spark.createDataFrame([(1, x.tolist()), (2, (2 * x[:48]).tolist())], "id int, x array<double>")
    out = {r.id: np.array(r.x) for r in arrays.fractional_delay(df, "x", 0.5 / 800, 800.0).collect()}
    assert out[1] == pytest.approx(np.cos(2 * np.pi * (t - 0.5) / 16), abs=1e-9)
    assert len(out[2]) == 48
    b, a = arrays.resonant2(0.02, 50.0, 800.0)
    flt = {r.id: np.array(r.x) for r in arrays.recursive_filter(df, "x", b, a, 16, 160).collect()}
    g = arrays.gain_at(b, a, 50.0, 800.0)
    want = np.real(g * np.exp(2j * np.pi * t / 16))
    assert flt[1][32:] == pytest.approx(want[32:], abs=1e-3)
    sh = df.select(arrays.shift_array(F.col("x"), 5).alias("x")).first().x
    assert sh == pytest.approx(np.roll(x, 5))


def test_append_missing_is_resumable(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    sinks.append_missing(spark, df.where("id < 4"), path, ["id"])
    sinks.append_missing(spark, df, path, ["id"])
    sinks.append_missing(spark, df, path, ["id"])
    assert spark.read.parquet(path).count() == 10


def test_patch_is_idempotent_and_guarded(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    df = spark.range(6).select("id", (F.col("id") / 10).alias("a"), F.lit(1.0).alias("b"))
    sinks.write_table(df, old)
    fix = lambda d: d.withColumn("a", F.when(F.col("a") < 0.25, 0.0).otherwise(F.col("a")))
    for _ in range(2):
        sinks.patch_table(spark, old, new, fix, ["a"])
    audit = quality.change_audit(spark.read.parquet(old).withColumn("g", F.lit("all")), spark.read.parquet(new).withColumn("g", F.lit("all")),
                                 ["id"], ["a"], F.col("a") < 0.25, ["g"]).first()
    assert (audit.masked, audit.changed, audit.changed_outside, audit.changed_other) == (3, 2, 0, 0)
    with pytest.raises(Exception, match="fixed column"):
        sinks.patch_table(spark, old, new, lambda d: d.withColumn("b", F.lit(2.0)), ["a"])


def test_window_arrays_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("g", 1, [0.1, 0.2])], "grid string, id int, x array<double>")
    sinks.write_windows(df, str(tmp_path / "w"), ["x"], ["grid"])
    back = spark.read.parquet(str(tmp_path / "w"))
    assert dict(back.dtypes)["x"] == "array<float>" and back.first().grid == "g"
    sinks.write_csv(df.select("grid", "id"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1


def test_record_files_round_trip(spark, tmp_path):
    cfg = SignalConfig()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 12))
    for sid, ends in ((7, (1, 2)), (8, (2,))):
        base = [f"net\\pex_MainBus{e}_MainLn1-2A" for e in ends]
        head = ["time", "other"] + [b + (f".{k}" if k else "") for b in base for k in range(6)]
        units = ["s", "x"] + records.UNITS * len(ends)
        body = [[1 + n / 9600, 0.0, *x[n, :6 * len(ends)]] for n in range(30)]
        text = "\n".join([",".join(head), ",".join(units)] + [",".join(repr(float(v)) for v in r) for r in body])
        (tmp_path / f"result{sid}.csv").write_text(text + "\n")
    lines = records.read_lines(spark, str(tmp_path))
    cmap = records.probe_header(lines)
    assert {(r.sim_idx, r.bus, r.first_pos) for r in cmap.collect()} == {(7, 1, 2), (7, 2, 8), (8, 2, 2)}
    assert records.header_violations(cmap).count() == 0
    s = records.read_records(spark, str(tmp_path), cfg)
    assert s.count() == 90
    got = np.array([[r.ia, r.vc] for r in s.where("sim_idx = 7 and bus = 2").orderBy("n").collect()])
    assert np.array_equal(got, x[:, [6, 11]])
    assert records.validate_samples(s, ["sim_idx", "bus"], 30).count() == 0
    assert {r.rule for r in records.validate_samples(s.where("n > 2"), ["sim_idx", "bus"], 30).collect()} == {"count", "start"}
    eps = spark.createDataFrame([(7, "MainLn1-2A", 1, 2), (8, "MainLn1-2A", 1, 2)], "sim_idx long, target string, bus_s int, bus_r int")
    ends = {(r.sim_idx, r.bus, r.end) for r in records.for_lines(s, eps).select("sim_idx", "bus", "end").distinct().collect()}
    assert ends == {(7, 1, 0), (7, 2, 1), (8, 2, 1)}


def test_label_split_and_parameter_files(spark, tmp_path):
    cols = list(tables.EPISODE_COLUMNS)[::-1]
    (tmp_path / "s.csv").write_text(",".join(cols) + "\n" + ",".join(["", "AB", "A", "1.5", "", "MainLn1-2", "1.1", "flt_3ph_shc", "12"]) + "\n")
    r = tables.read_episodes(spark, str(tmp_path / "s.csv")).first()
    assert (r.sim_idx, r.etype, r.location, r.event_start, r.duration) == (12, "flt_3ph_shc", None, 1.1, None)
    (tmp_path / "train.txt").write_text("adapt:dl:1\n\nadapt:dl:22\n")
    assert [tuple(x)[:3] for x in tables.read_splits(spark, str(tmp_path / "train.txt"), "train").collect()] == [("adapt", "dl", 1), ("adapt", "dl", 22)]
    (tmp_path / "bad.txt").write_text("adapt:dl\n")
    with pytest.raises(Exception, match="bad split line"):
        tables.read_splits(spark, str(tmp_path / "bad.txt"), "x").collect()
    (tmp_path / "lines.csv").write_text("line,length_km,rline,xline,rline0,xline0\nMainLn1-2,10,0.1,0.2,0.3,0.4\n")
    from faultspark.operators.lines import totals
    t = totals(tables.read_line_params(spark, str(tmp_path / "lines.csv"))).first()
    assert (t.z1r, t.z1x, t.z0r, t.z0x) == pytest.approx((1, 2, 3, 4))


def test_rows_without_order_or_group(spark):
    """Rows whose order value is NULL come first, and the NULL group is resampled like any other."""
    rows = [("a", None, 1.0)] + [("a", i, float(i)) for i in range(9)] + [(None, i, 2.0) for i in range(5)] + [(None, None, 2.0)]
    df = spark.createDataFrame(rows, "g string, ep long, e double")
    out = numbering.number_rows(df, ["g"], ["ep"], F.floor(F.col("ep") / 4), "i", total="n").collect()
    assert sorted((r.g or "", r.i) for r in out) == sorted([("a", i) for i in range(10)] + [("", i) for i in range(6)])
    assert all(r.i == 0 for r in out if r.ep is None) and {(r.g, r.n) for r in out} == {("a", 10), (None, 6)}
    reps = resample.hash_replicates(df, ["g"], "ep", {"e": F.col("e")}, 20).collect()
    assert {(r.g, r.rep) for r in reps} == {(g, k) for g in ("a", None) for k in range(20)}
    assert all(r.wins == (10 if r.g else 6) for r in reps)


def test_metric_names(spark):
    m = spark.createDataFrame([("errorA", 1234.567), ("errorB", 0.5)], "name string, v double")
    assert {(r.name, r.text) for r in report.named_metrics(m, "name", "v", 2).collect()} == {("errorA", "1,234.57"), ("errorB", "0.50")}
    for bad in ("error_a", "error1", "", None, "errorA"):
        with pytest.raises(Exception, match="letters only|not unique"):
            report.named_metrics(m.unionByName(spark.createDataFrame([(bad, 1.0)], "name string, v double")), "name", "v", 2).collect()


def test_prefix_sums_sort_rows_once(spark):
    df = spark.range(40).selectExpr("IF(id % 4 = 0, NULL, id % 4) AS g", "IF(id % 5 = 0, NULL, 'x') AS t", "id AS x")
    joins = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = numbering.number_rows(df, ["g", "t"], ["x"], F.floor(F.col("x") / 7), "n", total="size")
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        for k, v in joins.items():
            spark.conf.set(k, v)
    assert sum("Sort [" in line for line in plan.splitlines()) == 6  # of the rows one only
    groups = {}
    for r in sorted(rows, key=lambda r: r.x):
        groups.setdefault((r.g, r.t), []).append(r)
    assert sum(map(len, groups.values())) == 40
    for g in groups.values():
        assert [(r.n, r["size"]) for r in g] == [(k, len(g)) for k in range(len(g))]


def test_draws_of_arrays_are_those_of_columns(spark):
    numbers = np.array([0, 9, 10, 99, 12345, 10 ** 7, 10 ** 18], np.int64)
    df = spark.createDataFrame([(int(v),) for v in numbers], "v bigint")
    assert [r.h for r in df.select(draws.hash64(3, F.lit(49), F.col("v")).alias("h")).collect()] == list(draws.md5_60("3|49|", numbers))


def test_hash_replicates_join_without_a_sort_of_draws(spark):
    df = spark.range(60).selectExpr("IF(id % 2 = 0, NULL, 'o') AS grid", "id % 20 AS ep", "id * 1.0 AS e")
    reps = resample.hash_replicates(df, ["grid"], "ep", {"s": F.col("e")}, 4)
    assert "ShuffledHashJoin" in reps._jdf.queryExecution().executedPlan().toString()
    sums = {g: sorted((r.ep, r.s, r.w) for r in df.where(F.col("grid").eqNullSafe(g)).groupBy("ep").agg(F.sum("e").alias("s"), F.count("*").alias("w")).collect())
            for g in (None, "o")}
    found = {(r.grid, r.rep): (r.s, r.wins) for r in reps.collect()}
    assert len(found) == 8
    for (g, rep), (s, wins) in found.items():
        picks = draws.md5_60(f"0|{rep}|", np.arange(len(sums[g]))) % len(sums[g])
        assert (s, wins) == (sum(sums[g][k][1] for k in picks), sum(sums[g][k][2] for k in picks))
