"""The append-only log and what resumes from it, the registry, locks, the gate's verdicts, and distances over subsets."""

import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import files
from sightline.operators import decisions, drift, journal, registry, splits, synthesis
from tests.test_drift import frame, kernel_distance

ALLOCATION = [(0, 5), (1, 3), (2, 4), (3, 0)]


def candidates(spark):
    rows = [(t, k, 100 * t + k, ["night", "fog", "dusk", "rain"][t]) for t in range(4) for k in range(30 if t != 2 else 6)]
    return spark.createDataFrame(rows, "target int, k long, image_id long, condition string"), spark.createDataFrame(ALLOCATION, "target int, quota long")


def judge(rows):
    why = F.when(F.col("k") % 3 == 0, F.array(F.lit("prompt"), F.lit("structure"))).when(F.col("k") % 5 == 0, F.array(F.lit("condition"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("reasons", why).withColumn("accepted", F.size("reasons") == 0)


def plain():
    out = []
    for t, quota in ALLOCATION:
        have = 0
        for k in range(30 if t != 2 else 6):
            if have < quota:
                out.append((t, k, bool(k % 3 and k % 5)))
                have += out[-1][2]
    return sorted(out)


def test_a_stopped_synthesis_goes_on_to_the_same_rows(spark, tmp_path):
    plan, allocation = candidates(spark)
    rows = lambda df: sorted((r.target, r.k, r.accepted) for r in df.collect())
    log, judged = str(tmp_path / "log"), []

    def counted(df):
        judged.extend(df.select("target", "k").collect())
        return judge(df)

    journal.synthesize(plan, allocation, counted, log, 2, most=1)
    (tmp_path / "log" / "_staged_left_behind").mkdir()  # what a lost run leaves
    assert journal.batches(spark, log) == [0]
    done = journal.synthesize(plan, allocation, counted, log, 3)
    assert rows(done) == plain() and len(judged) == len(set(judged))  # nothing is judged twice
    before = journal.batches(spark, log)
    assert rows(journal.synthesize(plan, allocation, judge, log, 50)) == plain() and journal.batches(spark, log) == before
    assert rows(journal.synthesize(plan, allocation, judge, str(tmp_path / "other"), 1000)) == plain()
    assert {r.reason: r.n for r in journal.rejections(done).collect()}["prompt"] == sum(not k % 3 for _, k, _ in plain())


def test_a_batch_is_written_once(spark, tmp_path):
    log = str(tmp_path / "log")
    assert journal.append(spark.range(3), log, 7) and not journal.append(spark.range(9), log, 7)
    staged = files.staging(log)
    spark.range(5).write.parquet(staged)
    assert not files.publish(spark, staged, f"{log}/batch=7")  # the other writer came first
    assert journal.read(spark, log, spark.range(1).schema).count() == 3 and os.listdir(log) == ["batch=7"]


def test_accepted_candidates_become_samples(spark):
    plan, _ = candidates(spark)
    samples = spark.createDataFrame([(k, 10, "day", "clear") for k in range(400)], "image_id long, width int, timeofday string, weather string")
    tried = judge(plan.filter("k in (1, 3)"))
    got = {r.condition: r for r in journal.finalize(tried, samples).collect()}
    assert {c: (r.timeofday, r.weather) for c, r in got.items()} == {"night": ("night", "clear"), "fog": ("day", "foggy"), "dusk": ("dawn", "clear"), "rain": ("day", "rainy")}
    assert (got["fog"].image_id, got["fog"].parent, got["fog"].source, got["fog"].width) == ("synthetic_1_00001_101", 101, "synthetic", 10)


def test_versions_are_given_once_and_the_champion_has_weights(spark, tmp_path):
    root, weights = str(tmp_path / "registry"), tmp_path / "w.pt"
    weights.write_bytes(b"w")
    assert registry.history(spark, root).count() == 0 and registry.champion(spark, root).count() == 0
    add = lambda arm, **more: registry.register(spark, root, str(weights), run_id="r", arm=arm, golden={"map": 0.5, "fog": None}, **more)
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(add, "abcd")) == [1, 2, 3, 4]
    assert add("e", promote=True, note="first") == 5 and add("f", promote=True, parent=5) == 6 and add("g") == 7
    registry.reject(spark, root, run_id="r", arm="h", reason="target")
    events = registry.history(spark, root)
    assert {r.event: r.n for r in events.groupBy("event").agg(F.count("*").alias("n")).collect()} == {"registered": 5, "promoted": 2, "rejected": 1}
    one = registry.champion(spark, root).first()
    assert (one.version, one.arm, one.parent, one.golden) == (6, "f", 5, {"map": 0.5, "fog": None})
    os.remove(one.weights)
    assert registry.champion(spark, root).count() == 0


def test_a_lock_notices_changed_labels_and_missing_images(spark, tmp_path):
    samples = spark.range(20).select(F.col("id").alias("image_id"), F.lit(100).alias("width"), F.lit(50).alias("height"))
    gt = spark.createDataFrame([(k, 1, k % 3, 1.0, 2.0, 30.5, 40.0) for k in range(20)], "image_id long, box_id long, cls int, x1 double, y1 double, x2 double, y2 double")
    golden, path = samples.filter("image_id < 5"), str(tmp_path / "golden")
    splits.write_lock(golden, samples, gt, path)
    assert splits.read_lock(samples, gt.withColumn("cls", F.when(F.col("image_id") == 9, 7).otherwise(F.col("cls"))), path).count() == 5
    with pytest.raises(ValueError, match="changed"):
        splits.read_lock(samples, gt.withColumn("x1", F.when(F.col("image_id") == 4, 1.5).otherwise(F.col("x1"))), path)
    with pytest.raises(ValueError, match="missing"):
        splits.read_lock(samples.filter("image_id <> 2"), gt, path)
    with pytest.raises(ValueError, match="already"):
        splits.write_lock(golden, samples, gt, path)


@pytest.mark.parametrize("deltas,promote,failed", [
    ({"overall": (0.01, 0.0), "night": (0.05, 0.01)}, True, set()),
    ({"overall": (0.01, 0.0), "night": (0.05, -0.01)}, False, {"target:night CI > 0"}),
    ({"overall": (-0.01, 0.0), "night": (0.05, 0.01)}, False, {"overall no-regression"}),
    ({"overall": (0.01, 0.0), "night": (0.01, 0.001)}, False, {"target:night gain"}),
    ({"overall": (0.01, 0.0)}, False, {"target:night"}),
])
def test_the_gate_promotes_and_rejects(spark, deltas, promote, failed):
    d = spark.createDataFrame([(s, x, low) for s, (x, low) in deltas.items()], "slice string, delta double, ci_low double")
    maps = lambda rows: spark.createDataFrame(rows, "slice string, map double, gated boolean")
    base, cand = maps([("overall", 0.5, True), ("day", 0.6, True), ("fog", 0.9, False)]), maps([("overall", 0.51, True), ("day", 0.59, True), ("fog", 0.1, False)])
    checks = decisions.gate_checks(d, base, cand, ["night"])
    assert {r.name for r in checks.collect() if not r.passed} == failed
    assert decisions.decide(checks).first().promote is promote


def test_a_slice_that_falls_is_rejected(spark):
    d = spark.createDataFrame([("overall", 0.1, 0.0), ("night", 0.1, 0.05)], "slice string, delta double, ci_low double")
    maps = lambda m: spark.createDataFrame([("day", m, True)], "slice string, map double, gated boolean")
    assert not decisions.decide(decisions.gate_checks(d, maps(0.6), maps(0.5), ["night"])).first().promote


def test_subset_distances_agree_with_numpy(spark):
    import hashlib

    r = np.random.default_rng(3)
    x, y = r.normal(size=(90, 5)).astype(np.float32).astype(float), r.normal(0.4, 1, (70, 5)).astype(np.float32).astype(float)
    hashed = lambda i: int(hashlib.sha256(str(i).encode()).hexdigest()[:8], 16) % drift.PRIME
    values = []
    for a, b in drift.subset_orders(7):
        first = lambda v, start: v[sorted(range(len(v)), key=lambda k: ((hashed(start + k) * a + b) % drift.PRIME, start + k))[:20]]  # noqa: B023, E731
        values.append(kernel_distance(first(x, 0), first(y, 1000), lambda p, q: (p @ q.T / 5 + 1) ** 3))
    got = drift.kid_subsets(frame(spark, x).repartition(4), frame(spark, y, 1000), 7, 20).first()
    assert (got.kid, got.kid_std) == (pytest.approx(np.mean(values), abs=1e-9), pytest.approx(np.std(values), abs=1e-9))
    assert drift.kid_subsets(frame(spark, x), frame(spark, []), 7).first().kid is None


def test_sources_are_limited_before_they_are_shuffled(spark):
    gt = spark.range(4000).selectExpr("id div 4 as image_id", "id as box_id", "cast(id % 8 as int) as cls")
    targets = spark.sql("select 0 as target, array(1, 2) as classes union all select 1, array(5)")
    ranked = synthesis.rank_sources(gt, targets, 5)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
    got = {(r.target, r["rank"]) for r in ranked.collect()}
    assert got == {(t, k) for t in (0, 1) for k in range(5)}
