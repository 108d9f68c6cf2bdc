"""The paired bootstrap against images that are really repeated."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import average_precision as ap
from sightline.operators import bootstrap, match
from sightline.sources.tables import Views
from tests.test_evaluation import DET, GT, random_scene

THR = [0.5, 0.75]


def scene(spark, seed):
    det, gt = random_scene(seed)
    rng = np.random.default_rng(seed)
    scores = rng.permutation(len(det)) / len(det)  # without ties
    return spark.createDataFrame([(*d[:-1], float(s)) for d, s in zip(det, scores)], DET), spark.createDataFrame(gt, GT)


def drawn(spark, images, replicates):
    """image_id and replicate, a row for each time that the image counts."""
    keys = images.select("image_id", bootstrap.image_key(0).alias("key")).distinct().collect()
    w = bootstrap.weights(np.array([r.key for r in keys], dtype=np.int64).view(np.uint64), replicates)
    rows = [(r.image_id, r.image_id * 100 + c, j) for r, mine in zip(keys, w) for j, n in enumerate(mine) for c in range(int(n))]
    return spark.createDataFrame(rows, "image_id long, copy long, replicate int")


def test_equals_ap_over_repeated_images(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "STEP", 16)
    det, gt = scene(spark, 3)
    images = spark.range(30).select(F.col("id").alias("image_id"), F.lit("all").alias("slice"))
    npos = match.positives(gt).select("cls", "image_id", "n")
    table = match.greedy_match(det, gt, THR)
    # the second model has half of the detections
    matches = [table, table.filter("det_id % 2 = 0")]
    got = {(r.model, r.replicate): r["map"] for r in bootstrap.replicate_maps(matches, npos, images, THR, 2, chunk_rows=20).collect()}
    copies = drawn(spark, images, 2)
    want = {}
    for j in range(3):
        mine = copies.filter(F.col("replicate") == j).drop("replicate")
        repeat = lambda t: t.join(mine, "image_id").drop("image_id").withColumnRenamed("copy", "image_id")  # noqa: E731, B023
        everyone = mine.select(F.col("copy").alias("image_id"), F.lit("all").alias("slice"))
        for model, m in enumerate(matches):
            want[model, j] = ap.mean_ap(ap.ap_table(repeat(m), repeat(npos), everyone, THR)).first()["map"]
    assert len(set(got.values())) > 4
    assert got == pytest.approx(want, abs=1e-12)


def test_weights_are_poisson():
    keys = np.random.default_rng(1).integers(0, 2**64, 2000, dtype=np.uint64)  # as hashes are
    w = bootstrap.weights(keys, 100)
    assert (w[:, 0] == 1).all() and (w == bootstrap.weights(keys, 100)).all()
    shares = [(w[:, 1:] == n).mean() for n in range(4)]
    assert shares == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], abs=0.005)
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.1


def test_draws_equal_a_search_and_points_take_their_largest_precision():
    keys = np.random.default_rng(2).integers(0, 2**64, 500, dtype=np.uint64)
    x = keys[:, None] + np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    drawn = np.searchsorted(bootstrap.CUMULATIVE, (x >> np.uint64(11)) * 2.0**-53, side="right")
    assert (bootstrap.weights(keys, 300)[:, 1:] == drawn).all() and bootstrap.SPLIT.sum() < 20
    for rows in (3, 200):
        found, npos = np.cumsum(drawn[:rows].astype(float), axis=0), np.where(np.arange(300) % 50 == 0, 0.0, 150.0 + np.arange(300) % 9)
        precision = np.random.default_rng(3).random(found.shape)
        best, want = np.full((bootstrap.POINTS, 300), 0.2), np.full((bootstrap.POINTS, 300), 0.2)
        bootstrap.raise_best(best, npos, found, precision)
        np.maximum.at(want, (bootstrap.reached(found, npos), np.arange(300)), precision)
        assert (best == want).all()


def test_slices_have_their_own_intervals(spark):
    det, gt = scene(spark, 5)
    better = gt.select("image_id", F.col("box_id").alias("det_id"), "cls", "x1", "y1", "x2", "y2", F.lit(0.9).alias("score"))
    npos = match.positives(gt).select("cls", "image_id", "n")
    images = spark.range(30).select(F.col("id").alias("image_id"), F.explode(F.array(F.lit("all"), F.when(F.col("id") < 15, "few"))).alias("slice")).filter("slice is not null")
    first, last = (match.greedy_match(d, gt, THR) for d in (det, better))
    found = {r.slice: r for r in bootstrap.bootstrap_delta(first, last, npos, images, THR, 20).collect()}
    assert set(found) == {"all", "few"}
    assert all(0 < r.ci_low <= r.ci_high and r.p_le_zero == 0 for r in found.values()) and found["all"].ci_low != found["few"].ci_low
    same = bootstrap.bootstrap_delta(first, first, npos, images.filter("slice = 'all'"), THR, 20).first()
    assert (same.delta, same.ci_low, same.ci_high, same.p_le_zero) == (0, 0, 0, 1)


def test_no_detections_and_no_boxes(spark):
    det, gt = scene(spark, 5)
    npos = match.positives(gt).select("cls", "image_id", "n")
    images = spark.range(30).select(F.col("id").alias("image_id"), F.lit("all").alias("slice"))
    table = match.greedy_match(det, gt, THR)
    none = bootstrap.bootstrap_delta(table.limit(0), table.limit(0), npos, images, THR, 5).first()
    assert (none.delta, none.p_le_zero) == (0, 1)
    assert bootstrap.bootstrap_delta(table, table, npos.limit(0), images, THR, 5).count() == 0


def test_all_arms_are_compared_in_one_pass(spark):
    det, gt = scene(spark, 4)
    images = spark.range(30).select(F.col("id").alias("image_id"), F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit("all"), F.lit("third"))).otherwise(F.array(F.lit("all")))).alias("slice"))
    npos = match.positives(gt).select("cls", "image_id", "n")
    table = match.greedy_match(det, gt, THR)
    half = table.filter("det_id % 2 = 0")
    got = {(r.arm, r.slice): r for r in bootstrap.compare({"same": table, "base": table, "half": half}, "base", npos, images, THR, 30).collect()}
    assert len(got) == 6
    for s in ("all", "third"):
        assert (got["same", s].delta, got["same", s].ci_low, got["same", s].ci_high, got["same", s].p_le_zero) == (0, 0, 0, 1)
        assert got["same", s].map == got["base", s].map > got["half", s].map
    pair = {r.slice: r for r in bootstrap.bootstrap_delta(table, half, npos, images, THR, 30).collect()}
    for s, r in pair.items():
        other = got["half", s]
        assert (other.delta, other.ci_low, other.ci_high, other.p_le_zero) == pytest.approx((r.delta, r.ci_low, r.ci_high, r.p_le_zero), abs=1e-12)


def largest(best):
    return np.maximum.accumulate(best[:, ::-1], axis=1)[:, ::-1]


@pytest.mark.parametrize("rows, before, alike", [(700, 0, True), (4_000, 50, False), (4_000, 400_000, True), (3_001, 20_000, False)])
def test_blocks_left_out_could_not_raise_a_precision(rows, before, alike):
    rng, replicates, k = np.random.default_rng(rows + before), 20, 3
    keys, u = rng.integers(0, 2**64, rows, dtype=np.uint64), rng.random(rows)
    tp = np.array([u < 0.6 - 0.1 * t - 0.2 * np.arange(rows) / (before + rows) for t in range(k)]).astype(int)
    judged = np.ones_like(tp) if alike else tp | (rng.random(tp.shape) < 0.9)
    true = np.floor(before * (0.6 - 0.1 * np.arange(k)))[:, None] + np.zeros(replicates + 1)
    every = np.full_like(true, before)
    npos = np.floor((before + rows) * 0.7) + rng.integers(-9, 9, replicates + 1)
    npos[:2] = 0, 5
    known, want = np.zeros((2, k, bootstrap.POINTS, replicates + 1))
    w = bootstrap.weights(keys, replicates)
    for t in range(k):
        found, counted = true[t] + np.cumsum(w * tp[t][:, None], axis=0), every[t] + np.cumsum(w * judged[t][:, None], axis=0)
        start = np.divide(true[t], every[t], out=np.zeros(replicates + 1), where=every[t] > 0)  # the end of the chunk before has it
        known[t, bootstrap.reached(true[t], npos), np.arange(replicates + 1)] = start
        want[t] = known[t]
        bootstrap.raise_best(want[t], npos, found, np.divide(found, counted, out=np.zeros_like(found), where=counted > 0))
    walked = bootstrap.raise_chunk(known, npos, keys, tp, judged, true.copy(), every.copy(), np.zeros_like(true))
    assert (largest(known) == largest(want)).all()
    if before > 10 * rows:  # bounds are close to the precision here
        assert walked < 0.6 * k * (replicates + 1) * -(-rows // bootstrap.STEP)


def test_chunks_of_many_scores_follow_the_cuts(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "STEP", 8)
    monkeypatch.setattr(bootstrap, "HELD", 1)
    det, gt = scene(spark, 3)
    images = spark.range(30).select(F.col("id").alias("image_id"), F.lit("all").alias("slice"))
    npos, table = match.positives(gt).select("cls", "image_id", "n"), match.greedy_match(det, gt, THR)
    maps = [{(r.model, r.replicate): r["map"] for r in bootstrap.replicate_maps([table], npos, images, THR, 20, chunk_rows=n).collect()} for n in (7, 10_000)]
    assert len(maps[0]) == 21 and maps[0] == maps[1]


def test_detections_of_some_images_are_those_of_all(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    night = v.samples().filter("timeofday = 'night'").select("image_id")
    for model in ("baseline", "candidate", "noisy"):
        some, every = v.det(model, "timeofday = 'night'"), v.det(model).join(night, "image_id", "left_semi")
        assert some.count() == every.count() > 0 and some.exceptAll(every).count() == 0


def test_matches_that_know_their_slices_are_not_joined_again(spark):
    det, gt = scene(spark, 6)
    names = ["few", "all"]
    images = spark.range(30).select(F.col("id").alias("image_id"), F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("id") < 15, "few"), F.when(F.col("id") < 9, "other")))).alias("slice"))
    marked = match.match_masks(det, gt, THR, images=ap.members(images, marked=names))
    wanted = images.filter(F.col("slice").isin(names))
    npos = match.positives(gt).select("cls", "image_id", "n")
    joined, known = (sorted(bootstrap.replicate_maps([m, m.filter("det_id % 2 = 0")], npos, wanted, THR, 5).collect()) for m in (match.match_masks(det, gt, THR), ap.by_mark(marked, names)))
    assert joined == known and {r.slice for r in known} == set(names)
    # the maps of all slices read the same table
    assert sorted(ap.ap_table(marked, npos, images, THR).collect()) == sorted(ap.ap_table(match.match_masks(det, gt, THR), npos, images, THR).collect())
