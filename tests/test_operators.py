"""Splits, validation, modes, synthesis and decisions."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import decisions, modes, splits, synthesis, validation


def samples(spark, n=600):
    rows = spark.range(n).select(F.col("id").alias("image_id"), (F.col("id") % 150).alias("group_id"), F.lit(1280).alias("width"), F.lit(720).alias("height"))
    tod = F.element_at(F.array(*map(F.lit, ("day", "night", "dawn"))), (F.col("image_id") % 3 + 1).cast("int"))
    return rows.withColumns({"timeofday": tod, "weather": F.when(F.col("image_id") % 5 == 0, "rainy").otherwise("clear"), "scene": F.lit("highway")})


SIZES = {"golden": {"day": 20, "night": 30, "dawn": 10}, "probe": {"day": 10, "night": 10, "dawn": 5}, "val_day": {"day": 20}}


def test_splits_are_disjoint_deterministic_and_independent_of_partitions(spark):
    s = samples(spark)
    a = {(r.image_id, r.split) for r in splits.make_splits(s, SIZES).collect()}
    b = {(r.image_id, r.split) for r in splits.make_splits(s.repartition(7), SIZES).collect()}
    assert a == b and len({i for i, _ in a}) == len(a)
    assert splits.check_disjoint(splits.make_splits(s, SIZES), s).count() == 0


def test_a_locked_golden_set_stays_and_missing_images_raise(spark):
    s = samples(spark)
    locked = s.filter("image_id < 20").select("image_id")
    got = splits.make_splits(s, SIZES, locked=locked).filter("split = 'golden'")
    assert {r.image_id for r in got.collect()} == set(range(20))
    with pytest.raises(ValueError):
        splits.make_splits(s, SIZES, locked=spark.range(5000, 5001).withColumnRenamed("id", "image_id"))


def test_stratification_is_proportional(spark):
    s = samples(spark, 1000).withColumn("group_id", F.col("image_id"))
    got = splits.stratified_take(s, 100, 1)
    assert got.count() == 100 and 18 <= got.filter("weather = 'rainy'").count() <= 22
    assert splits.stratified_take(s, 0, 1).count() == 0


def test_digest_does_not_depend_on_order(spark):
    s = samples(spark, 50)
    gt = s.select("image_id", F.lit(1).cast("long").alias("box_id"), F.lit(2).alias("cls"), *[F.lit(x).alias(c) for c, x in (("x1", 1.0), ("y1", 2.0), ("x2", 3.5), ("y2", 4.25))])
    a, b = validation.digest(s, gt).first()[0], validation.digest(s.repartition(5), gt.orderBy(F.desc("image_id"))).first()[0]
    assert a == b != validation.digest(s, gt.withColumn("x2", F.lit(3.6))).first()[0]


def test_validation_names_each_problem(spark):
    s = samples(spark, 3).unionByName(samples(spark, 1))
    gt = spark.createDataFrame([(1, 1, 99, 0.0, 0.0, 5.0, 5.0), (2, 1, 0, 5.0, 5.0, 5.0, 9.0), (2, 2, 0, 0.0, 0.0, 1290.0, 9.0)], "image_id long, box_id long, cls int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.image_id, r.problem) for r in validation.validate(s, gt).collect()}
    assert got == {(0, "duplicate id"), (1, "class out of range"), (2, "degenerate box"), (2, "box outside image")}


def test_allocation_is_the_largest_remainder(spark):
    t = spark.createDataFrame([(0, 30.0), (1, 10.0)], "target int, excess_errors double")
    assert sorted(r.quota for r in synthesis.allocate(t, 101).collect()) == [25, 76]


def test_quota_stops_at_the_last_accepted(spark):
    c = spark.createDataFrame([(0, k, k % 2 == 1) for k in range(10)], "target int, k int, accepted boolean")
    a = spark.createDataFrame([(0, 2)], "target int, quota long")
    assert sorted(r.k for r in synthesis.accept_until_quota(c, a).collect()) == [0, 1, 2, 3]


def gate(spark, delta=0.05, low=0.01, overall=0.0, other=0.3):
    deltas = spark.createDataFrame([("night", delta, low), ("overall", overall, -0.01)], "slice string, delta double, ci_low double")
    base = spark.createDataFrame([("day", 0.3), ("rainy", None)], "slice string, map double")
    cand = spark.createDataFrame([("day", other, True), ("rainy", 0.1, True)], "slice string, map double, gated boolean")
    return decisions.decide(decisions.gate_checks(deltas, base, cand, ["night"])).first().promote


def test_gate(spark):
    assert gate(spark)
    assert not gate(spark, delta=0.01)
    assert not gate(spark, low=-0.01)
    assert not gate(spark, overall=-0.01)
    assert not gate(spark, other=0.27)


def test_psi_of_equal_and_shifted_samples(spark):
    a = spark.range(1000).select((F.col("id") / 1000).alias("x"))
    assert decisions.psi(a, a, "x").first()[0] == pytest.approx(0, abs=1e-9)
    assert decisions.psi(a, a.select((F.col("x") * F.col("x")).alias("x")), "x").first()[0] > 0.2
    assert decisions.psi(a.select(F.lit(1.0).alias("x")), a, "x").first()[0] == 0.0


def test_cluster_lift(spark):
    items = spark.createDataFrame([(0, True, 1.0)] * 3 + [(1, False, 2.0)] * 3 + [(-1, True, 1.0)], "cluster int, is_error boolean, weight double")
    got = {r.cluster: r for r in modes.cluster_stats(items).collect()}
    assert set(got) == {0, 1} and got[0].lift == pytest.approx(2.5) and got[1].excess_errors == pytest.approx(-2.4)
