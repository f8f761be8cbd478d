from pyspark.sql import functions as F

from faultspark.operators import model
from faultspark.operators.features import TD_FEATURES


def table(spark):
    h = lambda k: (F.pmod(F.hash("id", F.lit(k)), F.lit(1000)) / 1000.0)
    cols = [h(i).alias(t) for i, t in enumerate(TD_FEATURES)]
    df = spark.range(1200).select("id", *cols)
    return df.withColumns({"y": F.col(TD_FEATURES[0]) * 0.8 + 0.1, "grid": F.when(F.col("id") < 800, "a").otherwise("b"),
                           "post_ms": (F.col("id") % 16 + 1) * 5.0})


def test_transfer_beats_the_constant(spark):
    t = table(spark).cache()
    p = model.BoostParams(max_iter=8, step=0.3, leaves=12, min_rows=10, seeds=(0, 1))
    out = model.evaluate_transfer(t, ["a"], "b", TD_FEATURES, p)
    m = model.metrics(out, ["direction"]).first()
    assert m.direction == "a_to_b" and m.n == 400
    assert m.mae < 12 and {"pred_s0", "pred_s1", "pred"} <= set(out.columns)


def test_ablations_resume(spark):
    t = table(spark).cache()
    p = model.BoostParams(max_iter=1, leaves=4, min_rows=10, seeds=(0,))
    groups = {"first": TD_FEATURES[:3], "rest": TD_FEATURES[3:6]}
    rows = model.run_ablations(t, [(["a"], "b"), (["b"], "a")], p, groups, done={("first", "a_to_b")}).collect()
    assert {(r.ablation, r.direction) for r in rows} == {("first", "b_to_a"), ("rest", "a_to_b"), ("rest", "b_to_a")}


def test_ablations_query_has_every_group_and_direction():
    from faultspark.plans.catalog import SQL

    for group in ("phasor", "td", "all"):
        for direction in ("('{}', 'even_to_odd', 'odd')", "('{}', 'odd_to_even', 'even')"):
            assert direction.format(group) in SQL["model_ablations"]
