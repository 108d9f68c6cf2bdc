"""Matching, average precision and error types on small scenes and against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import partitions
from sightline.operators import average_precision as ap
from sightline.operators import match, tide, validation
from sightline.plans import evaluation
from sightline.schema import THRESHOLDS
from sightline.sources.tables import Views

DET = "image_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double, score double"
GT = "image_id long, box_id long, cls int, x1 double, y1 double, x2 double, y2 double"
SAMPLES = "image_id long, group_id long, width int, height int, timeofday string, weather string, scene string"


def frames(spark, det, gt):
    return spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)


def overlap(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return 0 if u <= 0 else w * h / u


def random_scene(seed, images=30):
    rng = np.random.default_rng(seed)
    det, gt = [], []
    for i in range(images):
        boxes = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in zip(rng.integers(0, 300, 6), rng.integers(0, 200, 6), rng.integers(8, 120, 6), rng.integers(8, 120, 6))]
        for k, b in enumerate(boxes[: rng.integers(0, 7)]):
            gt.append((i, k, int(rng.integers(0, 3)), *b))
        for k, b in enumerate(boxes):
            move = rng.integers(-8, 9, 4)
            b = (b[0] + move[0], b[1] + move[1], max(b[0] + move[0] + 2, b[2] + move[2]), max(b[1] + move[1] + 2, b[3] + move[3]))
            det.append((i, k, int(rng.integers(0, 3)), *map(float, b), float(rng.integers(0, 20)) / 20))
    return det, gt


def plain_match(det, gt, t, low=0, high=1e10):
    out = {}
    for i in {d[0] for d in det}:
        taken = set()
        for d in sorted([d for d in det if d[0] == i], key=lambda d: (-d[7], d[1])):
            near = [(not low <= (g[5] - g[3]) * (g[6] - g[4]) <= high, -overlap(d[3:7], g[3:7]), g[1]) for g in gt if g[0] == i and g[2] == d[2] and g[1] not in taken and overlap(d[3:7], g[3:7]) >= t]
            size = (d[5] - d[3]) * (d[6] - d[4])
            if near:
                ign, _, box = min(near)
                taken.add(box)
                out[i, d[1]] = (not ign, ign)
            else:
                out[i, d[1]] = (False, not low <= size <= high)
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("area", ["all", "small", "medium"])
def test_greedy_match_agrees_with_a_plain_loop(spark, seed, area):
    det, gt = random_scene(seed)
    got = match.greedy_match(*frames(spark, det, gt), [0.5, 0.75], [area]).collect()
    for k, t in enumerate((0.5, 0.75)):
        expected = plain_match(det, gt, t, *match.AREAS[area])
        assert {(r.image_id, r.det_id): (r[area][k].tp, r[area][k].ign) for r in got} == expected


def test_crowds_are_walked_and_lone_pairs_are_not_told_apart(spark):
    """Boxes that many detections share, box ids that are equal modulo 64, lone pairs beside them, and sizes."""
    rng = np.random.default_rng(4)
    det, gt = [], []
    for i in range(12):
        for k in range(5):
            x, y = (float(rng.integers(0, 12)), 20.0) if i < 6 else (200.0 * k, 20.0)
            gt.append((i, 64 * k, int(i % 3 == 0 and k % 2), x, y, x + 30 + 10 * k, y + 40))
            for j in range(2 if i % 2 else 1):
                det.append((i, 2 * k + j, int(i % 3 == 0 and k % 2), x + j, y - 1, x + 29 + 10 * k, y + 41, float(rng.integers(0, 6)) / 6))
    thresholds = [0.5, 0.7, 0.95]
    got = match.match_masks(*frames(spark, det, gt), thresholds, ["all", "small", "medium"]).collect()
    for area in ("all", "small", "medium"):
        for k, t in enumerate(thresholds):
            assert {(r.image_id, r.det_id): (bool(r[area].tp >> k & 1), bool(r[area].ign >> k & 1)) for r in got} == plain_match(det, gt, t, *match.AREAS[area])


def test_tasks_follow_the_rows_of_boxes(spark, monkeypatch):
    monkeypatch.setattr(partitions, "ROWS", 500)
    v = Views(spark, "/root/testdata/sf0.001")
    n = -(-v.table("lineitem").count() // 500)
    assert n > 4 and [f.rdd.getNumPartitions() for f in (v.gt(), v.det(), v.det("noisy"), match.match_masks(v.det(), v.gt()))] == [n] * 4


def table(spark, det, gt, weights=None):
    d, g = frames(spark, det, gt)
    weights = weights if weights is not None else d.select("image_id").union(g.select("image_id")).distinct().withColumn("slice", F.lit("all"))
    return ap.ap_table(match.greedy_match(d, g, [0.5]), match.positives(g).select("cls", "image_id", "n"), weights, [0.5])


def test_average_precision_agrees_with_a_plain_loop(spark):
    det, gt = random_scene(5)
    got = {r.cls: r.ap for r in table(spark, det, gt).collect()}
    hits = plain_match(det, gt, 0.5)
    for c in {g[2] for g in gt}:
        n = sum(g[2] == c for g in gt)
        tp = np.cumsum([hits[d[0], d[1]][0] for d in sorted([d for d in det if d[2] == c], key=lambda d: (-d[7], d[0], d[1]))])
        rec, prec = tp / n, tp / np.arange(1, len(tp) + 1)
        assert got[c] == pytest.approx(np.mean([max(prec[rec >= i * 0.01], default=0) for i in range(101)]), abs=1e-9)


def test_ranges_cut_ties_and_keep_models_apart(spark, monkeypatch):
    monkeypatch.setattr(ap, "RANGE", 9)
    det, gt = random_scene(6, 15)
    det = [(*d[:7], round(d[7], 1)) for d in det]  # many equal scores, which a range may cut
    d, g = frames(spark, det, gt)
    m = match.greedy_match(d, g, [0.5, 0.75])
    both = m.withColumn("arm", F.lit("all")).unionByName(m.filter("cls = 0").withColumn("arm", F.lit("one")))
    npos = match.positives(g).select("cls", "image_id", "n", F.explode(F.array(F.lit("all"), F.lit("one"))).alias("arm"))
    images = g.select("image_id").union(d.select("image_id")).distinct()
    weights = images.select("image_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("part")).filter("part = 0 or image_id % 2 = 0")
    got = {(r.part, r.arm, r.cls, r.thr): r.ap for r in ap.ap_table(both, npos, weights, [0.5, 0.75], group="part", by=["arm", "cls"]).collect()}
    assert len(got) == 8 * len({b[2] for b in gt})
    for (part, arm, c, t), value in got.items():
        mine = lambda x: x[2] == c and (part == 0 or x[0] % 2 == 0)
        n, hits = sum(map(mine, gt)), plain_match(det, gt, t)
        tp = np.cumsum([hits[d[0], d[1]][0] for d in sorted(filter(mine, det), key=lambda d: (-d[7], d[0], d[1])) if arm == "all" or c == 0])
        rec, prec = tp / n, tp / np.arange(1, len(tp) + 1)
        assert value == pytest.approx(np.mean([max(prec[rec >= i * 0.01], default=0) for i in range(101)]), abs=1e-9)


def test_detections_are_not_broadcast(spark, monkeypatch):
    plans, store = [], ap.stored
    monkeypatch.setattr(ap, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    det, gt = frames(spark, *random_scene(3))
    images = spark.createDataFrame([(i, "all") for i in range(30)], "image_id long, slice string")
    matched = store(match.greedy_match(det, gt, [0.5]))
    ap.ap_table(matched, match.positives(gt).select("cls", "image_id", "n"), images, [0.5])
    assert len(plans) == 1 and "BroadcastHashJoin" not in plans[0] and "SortMergeJoin" in plans[0]


def test_perfect_and_missing_detections(spark):
    gt = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 20.0, 20.0, 40.0, 40.0)]
    det = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.9)]
    assert {r.cls: r.ap for r in table(spark, det, gt).collect()} == {0: pytest.approx(1.0), 1: 0.0}


def test_a_weight_of_two_is_a_copied_image(spark):
    det, gt = random_scene(9, 12)
    d, g = frames(spark, det, gt)
    images = d.select("image_id").distinct()
    heavy = images.select("image_id", F.lit("all").alias("slice"), F.when(F.col("image_id") < 4, 2.0).otherwise(1.0).alias("w"))
    shift = lambda rows: rows + [(r[0] + 1000, *r[1:]) for r in rows if r[0] < 4]
    a = {r.cls: r.ap for r in table(spark, det, gt, heavy).collect()}
    b = {r.cls: r.ap for r in table(spark, shift(det), shift(gt)).collect()}
    assert a == pytest.approx(b, abs=0.02)  # equal scores of a copy lie side by side, so steps differ at ties only


@pytest.mark.parametrize(
    "box,cls,kind",
    [((10, 10, 60, 60), 0, "tp"), ((10, 10, 60, 60), 2, "cls"), ((40, 40, 90, 90), 0, "bkg"), ((30, 10, 80, 60), 0, "loc"), ((30, 10, 80, 60), 1, "both"), ((150, 10, 160, 20), 0, "bkg")],
)
def test_error_kinds(spark, box, cls, kind):
    gt = [(1, 0, 0, 10.0, 10.0, 60.0, 60.0), (1, 1, 2, 100.0, 100.0, 180.0, 180.0)]
    d, g = frames(spark, [(1, 0, cls, *map(float, box), 0.9)], gt)
    samples = spark.createDataFrame([(1, 1, 200, 200, "day", "clear", "highway")], SAMPLES)
    found = [r for r in tide.records(samples, d, g).collect() if r.kind != "miss"]
    assert [r.kind for r in found] == [kind]


def test_duplicates_and_uncovered_misses(spark):
    d, g = frames(spark, [(1, 0, 0, 10.0, 10.0, 60.0, 60.0, 0.9), (1, 1, 0, 11.0, 10.0, 60.0, 60.0, 0.8), (1, 2, 0, 0.0, 0.0, 5.0, 5.0, 0.1)], [(1, 0, 0, 10.0, 10.0, 60.0, 60.0), (1, 1, 2, 100.0, 100.0, 180.0, 180.0)])
    samples = spark.createDataFrame([(1, 1, 200, 200, "day", "clear", "highway"), (2, 1, 200, 200, "day", "clear", "highway")], SAMPLES)
    s = tide.summary(tide.records(samples, d, g)).first()
    assert (s.tp, s.dupe, s.miss, s.miss_uncovered, s.precision, s.recall) == (1, 1, 1, 1, 0.5, 0.5)


def test_images_are_walked_once_for_detections_and_misses(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    plan = tide.records(v.samples(), v.det("noisy"), v.gt())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and plan.count("parquet") == 5  # images; detections, their images' status and false ones; boxes


def test_label_text_is_made_before_the_groups(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    plan = validation.label_lines(v.samples(), v.gt())._jdf.queryExecution().optimizedPlan().toString()
    gathers = next(line for line in plan.splitlines() if "collect_list" in line)
    assert "floor" not in gathers.lower()


def test_images_are_matched_whole_whatever_the_batches(spark):
    det, gt = random_scene(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        images = spark.createDataFrame([(i, i * 10) for i in range(0, 30, 2)], "image_id long, mark long")
        got = match.match_masks(*frames(spark, det, gt), [0.5, 0.75], ["all", "small"], images=images).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.mark == r.image_id * 10 for r in got)
    for area in ("all", "small"):
        for k, t in enumerate((0.5, 0.75)):
            expected = {d: x for d, x in plain_match(det, gt, t, *match.AREAS[area]).items() if d[0] % 2 == 0}
            assert {(r.image_id, r.det_id): (bool(r[area].tp >> k & 1), bool(r[area].ign >> k & 1)) for r in got} == expected


def test_matching_moves_boxes_and_detections_once(spark, monkeypatch):
    monkeypatch.setattr(partitions, "ROWS", 500)
    v = Views(spark, "/root/testdata/sf0.001")
    images = ap.members(ap.slice_membership(v.dealt_samples()))
    plan = match.match_masks(v.det(), v.gt(), images=images)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "aggregate(" not in plan


def test_groups_joined_before_the_match_give_the_same_table(spark):
    d, g = frames(spark, *random_scene(3))
    weights = spark.createDataFrame([(i, s, 1.0 + i % 3) for i in range(29) for s in ("a", "b", "c") if (i + ord(s)) % 4], "image_id long, slice string, w double")
    late = ap.ap_table(match.match_masks(d, g, [0.5]), match.positives(g), weights, [0.5])
    early = ap.ap_table(match.match_masks(d, g, [0.5], images=ap.members(weights)), match.counted(g), weights, [0.5])
    assert sorted(late.collect()) == sorted(early.collect()) and early.count() == 9


def test_models_are_joined_to_their_slices_where_they_are_matched(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    weights = ap.slice_membership(v.dealt_samples())
    matches = evaluation._matches_of_models(v, weights, ("baseline", "candidate"))
    assert all("members" in m.columns and "Relation" in m._jdf.queryExecution().optimizedPlan().toString() for m in matches.values())  # stored, and not matched again
    both = evaluation._ap_of_models(v, weights, matches).collect()
    alone = evaluation._ap(v, "candidate", THRESHOLDS).collect()
    assert len(both) == 2 * len(alone) > 0
    assert {(r.slice, r.cls, r.thr): r.ap for r in both if r.arm == "candidate"} == {(r.slice, r.cls, r.thr): r.ap for r in alone}
