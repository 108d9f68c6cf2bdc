"""Detection evaluation: matching, average precision, slices, sizes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.decimals import fixed
from sightline.functions.lineage import stored
from sightline.operators import average_precision as ap
from sightline.operators import match, report
from sightline.plans.oracle import IOU, views
from sightline.schema import AREAS, GATED_IMAGES, SLICES, THRESHOLDS
from sightline.sources.tables import Views

QUERIES, SQL = {}, {}


def plan(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def sql_slices(alias: str = "samples") -> str:
    return "slices AS (" + " UNION ALL ".join(f"SELECT image_id, '{n}' AS slice FROM {alias} WHERE {p}" for n, p in SLICES.items()) + ")"


def sql_match(model: str, thresholds: list[float], areas: list[str] = ("all",)) -> str:
    """Tables of (area, thr, image_id, det_id, cls, score, tp, ign), by a recursive walk over each image's detections."""
    ranges = ", ".join(f"('{a}', {AREAS[a][0]!r}::DOUBLE, {AREAS[a][1]!r}::DOUBLE)" for a in areas)
    grid = ", ".join(f"({t!r}::DOUBLE)" for t in thresholds)
    return f"""
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rk FROM det_{model}) WHERE rk <= 100),
dd AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY score DESC, det_id) AS k FROM top),
cand AS (SELECT d.image_id, d.det_id, g.box_id, {IOU} AS iou, (g.x2-g.x1)*(g.y2-g.y1) AS garea FROM dd d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls),
areas(area, lo, hi) AS (VALUES {ranges}), thrs(thr) AS (VALUES {grid}),
ca AS (SELECT area, image_id, det_id, list(struct_pack(iou := iou, box_id := box_id, inside := garea BETWEEN lo AND hi) ORDER BY CASE WHEN garea BETWEEN lo AND hi THEN 0 ELSE 1 END, iou DESC, box_id) AS c
    FROM cand, areas WHERE iou >= {min(thresholds)!r}::DOUBLE GROUP BY area, image_id, det_id),
dc AS (SELECT a.area, d.image_id, d.cls, d.det_id, d.k, d.score, NOT ((d.x2-d.x1)*(d.y2-d.y1) BETWEEN lo AND hi) AS outside, coalesce(c, []) AS c
    FROM dd d CROSS JOIN areas a LEFT JOIN ca ON ca.area = a.area AND ca.image_id = d.image_id AND ca.det_id = d.det_id),
walk AS (
    SELECT DISTINCT area, thr, image_id, cls, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BOOLEAN) AS outside, CAST(NULL AS BIGINT) AS hit, CAST(NULL AS BOOLEAN) AS hit_inside FROM dc, thrs
    UNION ALL
    SELECT area, thr, image_id, cls, k, CASE WHEN h IS NULL THEN taken ELSE list_append(taken, h.box_id) END, det_id, score, outside, h.box_id, h.inside
    FROM (SELECT w.area, w.thr, w.image_id, w.cls, d.k, w.taken, d.det_id, d.score, d.outside, list_filter(d.c, lambda x: x.iou >= w.thr AND NOT list_contains(w.taken, x.box_id))[1] AS h
        FROM walk w JOIN dc d ON d.area = w.area AND d.image_id = w.image_id AND d.cls = w.cls AND d.k = w.k + 1)),
matched AS (SELECT area, thr, image_id, cls, det_id, score, coalesce(hit_inside, false) AS tp, CASE WHEN hit IS NOT NULL THEN NOT hit_inside ELSE outside AND area <> 'all' END AS ign FROM walk WHERE k > 0),
npos AS (SELECT area, cls, image_id, count(*) AS n FROM gt, areas WHERE (x2-x1)*(y2-y1) BETWEEN lo AND hi GROUP BY area, cls, image_id)"""


#: From matched, npos and a table weights(scope, image_id) to ap(scope, area, cls, thr, ap).
SQL_AP = """
total AS (SELECT scope, area, cls, CAST(sum(n) AS DOUBLE) AS npos FROM npos JOIN weights USING (image_id) GROUP BY scope, area, cls),
run AS (SELECT scope, area, cls, thr, CAST(sum(CASE WHEN tp THEN 1 ELSE 0 END) OVER w AS DOUBLE) AS ctp, CAST(sum(CASE WHEN tp THEN 0 ELSE 1 END) OVER w AS DOUBLE) AS cfp
    FROM matched JOIN weights USING (image_id) WHERE NOT ign
    WINDOW w AS (PARTITION BY scope, area, cls, thr ORDER BY score DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT scope, area, cls, thr, ctp / npos AS rec, ctp / (ctp + cfp) AS prec FROM run JOIN total USING (scope, area, cls)),
env AS (SELECT scope, area, cls, thr, rec, max(prec) OVER (PARTITION BY scope, area, cls, thr ORDER BY rec DESC) AS e FROM pr),
lev AS (SELECT scope, area, cls, thr, rec, max(e) AS e, coalesce(lag(rec) OVER (PARTITION BY scope, area, cls, thr ORDER BY rec), -1) AS prev FROM env GROUP BY scope, area, cls, thr, rec),
hits AS (SELECT scope, area, cls, thr, sum(e * len(list_filter(range(0, 101), lambda i: i * 0.01e0 <= rec AND i * 0.01e0 > prev))) / 101 AS ap FROM lev GROUP BY scope, area, cls, thr),
ap AS (SELECT t.scope, t.area, t.cls, g.thr, coalesce(h.ap, 0) AS ap FROM total t CROSS JOIN thrs g LEFT JOIN hits h ON h.scope = t.scope AND h.area = t.area AND h.cls = t.cls AND h.thr = g.thr WHERE t.npos > 0)"""
TWO = [0.5, 0.75]
WEIGHTS = "weights AS (SELECT slice AS scope, image_id FROM slices)"


@plan("slice_counts", views("samples") + f", {sql_slices()} SELECT slice, count(*) AS images, count(*) >= {GATED_IMAGES} AS gated FROM slices GROUP BY slice")
def slice_counts(v: Views):
    return ap.slice_membership(v.samples()).groupBy("slice").agg(F.count(F.lit(1)).alias("images")).withColumn("gated", F.col("images") >= GATED_IMAGES)


@plan("iou_pairs", views("gt", "det_baseline") + f", p AS (SELECT d.image_id, d.cls = g.cls AS same_class, {IOU} AS iou FROM det_baseline d JOIN gt g USING (image_id)) SELECT image_id, same_class, count(*) AS pairs, round(sum(iou), 6) AS total, round(max(iou), 9) AS best FROM p WHERE iou > 0 GROUP BY image_id, same_class")
def iou_pairs(v: Views):
    pairs = match.iou_pairs(v.det(), v.gt())
    return pairs.groupBy("image_id", "same_class").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("iou"), 6).alias("total"), F.round(F.max("iou"), 9).alias("best"))


@plan("top_detections", views("det_baseline") + " SELECT image_id, det_id, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rk FROM det_baseline) WHERE rk <= 5")
def top_detections(v: Views):
    return match.top_detections(v.det(), 5).select("image_id", "det_id", "score")


@plan("confident_detections", views("det_baseline") + " SELECT image_id, count(*) AS n, round(sum(score), 9) AS score FROM det_baseline WHERE score >= 0.25e0 GROUP BY image_id")
def confident_detections(v: Views):
    return v.det().filter("score >= 0.25D").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 9).alias("score"))


@plan("greedy_match", views("gt", "det_baseline", recursive=True) + "," + sql_match("baseline", TWO) + " SELECT image_id, det_id, cls, max(CASE WHEN thr = 0.5e0 THEN CAST(tp AS INTEGER) END) AS tp50, max(CASE WHEN thr = 0.75e0 THEN CAST(tp AS INTEGER) END) AS tp75 FROM matched GROUP BY image_id, det_id, cls")
def greedy_match(v: Views):
    m = match.greedy_match(v.det(), v.gt(), TWO)
    return m.select("image_id", "det_id", "cls", *[F.col("all")[k]["tp"].cast("int").alias(n) for k, n in enumerate(("tp50", "tp75"))])


@plan("match_area", views("gt", "det_baseline", recursive=True) + "," + sql_match("baseline", [0.5], ["small", "medium", "large"]) + " SELECT area, cls, CAST(sum(CASE WHEN tp THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN ign THEN 1 ELSE 0 END) AS BIGINT) AS ignored, count(*) AS n FROM matched GROUP BY area, cls")
def match_area(v: Views):
    names = ["small", "medium", "large"]
    m = match.greedy_match(v.det(), v.gt(), [0.5], names)
    long = m.select("cls", F.explode(F.array(*[F.struct(F.lit(a).alias("area"), F.col(a)[0]["tp"].alias("tp"), F.col(a)[0]["ign"].alias("ign")) for a in names])).alias("r"))
    return long.groupBy("r.area", "cls").agg(F.count_if("r.tp").alias("tp"), F.count_if("r.ign").alias("ignored"), F.count(F.lit(1)).alias("n"))


@plan("positives", views("gt") + ", areas(area, lo, hi) AS (VALUES " + ", ".join(f"('{a}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for a, (lo, hi) in AREAS.items()) + ") SELECT area, cls, count(*) AS n, count(DISTINCT image_id) AS images FROM gt, areas WHERE (x2-x1)*(y2-y1) BETWEEN lo AND hi GROUP BY area, cls")
def positives(v: Views):
    return match.positives(v.gt(), list(AREAS)).groupBy("area", "cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("images"))


def _ap(v: Views, model: str, thresholds: list[float], weights=None, area: str = "all"):
    weights = weights if weights is not None else ap.slice_membership(v.dealt_samples())
    m = stored(match.match_masks(v.det(model), v.gt(), thresholds, [area], images=ap.members(weights)))  # its scores are read for bins and again for ranks
    return ap.ap_table(m, match.counted(v.gt(), [area]), weights, thresholds, area)


def _matches_of_models(v: Views, weights, models, marked=()):
    """Match tables by model, with the members (and marks) of their images: each is read several times, and none is matched or joined to its slices again."""
    return {arm: stored(match.match_masks(v.det(arm), v.gt(), THRESHOLDS, images=ap.members(weights, marked=marked))) for arm in models}


def _ap_of_models(v: Views, weights, matches: dict):
    """AP of several models, told apart by the column arm, over all slices in one pass."""
    npos = match.counted(v.gt()).select("cls", "image_id", "n", F.explode(F.array(*map(F.lit, matches))).alias("arm"))
    rows = functools.reduce(DataFrame.unionByName, (m.withColumn("arm", F.lit(arm)) for arm, m in matches.items()))
    return ap.ap_table(rows, npos, weights, THRESHOLDS, by=["arm", "cls"])


@plan("ap_table", views("samples", "gt", "det_baseline", recursive=True) + f", {sql_slices()}," + sql_match("baseline", THRESHOLDS) + f", {WEIGHTS}," + SQL_AP + " SELECT scope AS slice, cls, thr, round(ap, 9) AS ap FROM ap")
def ap_table(v: Views):
    return _ap(v, "baseline", THRESHOLDS).withColumn("ap", F.round("ap", 9))


@plan("map_by_slice", views("samples", "gt", "det_baseline", recursive=True) + f", {sql_slices()}," + sql_match("baseline", THRESHOLDS) + f", {WEIGHTS}," + SQL_AP + " SELECT scope AS slice, round(avg(ap), 9) AS map, round(avg(ap) FILTER (WHERE thr = 0.5e0), 9) AS map50, round(avg(ap) FILTER (WHERE thr = 0.75e0), 9) AS map75 FROM ap GROUP BY scope")
def map_by_slice(v: Views):
    out = ap.mean_ap(_ap(v, "baseline", THRESHOLDS))
    return out.select("slice", *[F.round(c, 9).alias(c) for c in ("map", "map50", "map75")])


@plan("map_by_size", views("gt", "det_baseline", recursive=True) + "," + sql_match("baseline", THRESHOLDS, ["small", "medium", "large"]) + ", weights AS (SELECT 'overall' AS scope, o_orderkey AS image_id FROM orders)," + SQL_AP + " SELECT area, round(avg(ap), 9) AS map FROM ap GROUP BY area")
def map_by_size(v: Views):
    names = ["small", "medium", "large"]
    everyone = v.dealt_samples().select("image_id", F.lit("overall").alias("slice"))
    m = stored(match.match_masks(v.det(), v.gt(), THRESHOLDS, names, images=ap.members(everyone)))
    sized = m.select("image_id", "det_id", "cls", "score", "members", F.inline(F.array(*[F.struct(F.lit(a).alias("area"), F.col(a).alias("result")) for a in names])))
    t = ap.ap_table(sized, match.counted(v.gt(), names), everyone, THRESHOLDS, "result", by=["area", "cls"])
    return t.groupBy("area").agg(F.round(F.avg("ap"), 9).alias("map"))


@plan("summary_per_class", views("gt", "det_baseline", recursive=True) + "," + sql_match("baseline", THRESHOLDS) + ", weights AS (SELECT 'overall' AS scope, o_orderkey AS image_id FROM orders)," + SQL_AP + " SELECT cls, round(avg(ap), 9) AS ap, CAST(max(npos) AS BIGINT) AS n_gt FROM ap JOIN total USING (scope, area, cls) GROUP BY cls")
def summary_per_class(v: Views):
    everyone = v.dealt_samples().select("image_id", F.lit("overall").alias("slice"))
    counts = v.gt().groupBy("cls").agg(F.count(F.lit(1)).alias("n_gt"))
    return _ap(v, "baseline", THRESHOLDS, everyone).groupBy("cls").agg(F.round(F.avg("ap"), 9).alias("ap")).join(counts, "cls")


@plan("eval_gated", views("samples", "gt", "det_candidate", recursive=True) + f", {sql_slices()}," + sql_match("candidate", THRESHOLDS) + f", {WEIGHTS}," + SQL_AP + f""",
m AS (SELECT scope AS slice, round(avg(ap), 9) AS map FROM ap GROUP BY scope),
c AS (SELECT slice, count(*) AS n_images FROM slices GROUP BY slice), b AS (SELECT slice, count(*) AS n_gt FROM slices JOIN gt USING (image_id) GROUP BY slice)
SELECT slice, map, n_images, n_gt, n_images >= {GATED_IMAGES} AS gated FROM m JOIN c USING (slice) JOIN b USING (slice)""")
def eval_gated(v: Views):
    members = ap.slice_membership(v.samples())
    images = members.groupBy("slice").agg(F.count(F.lit(1)).alias("n_images"))
    boxes = v.gt().groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).join(members, "image_id").groupBy("slice").agg(F.sum("n").alias("n_gt"))
    out = ap.mean_ap(_ap(v, "candidate", THRESHOLDS)).select("slice", F.round("map", 9).alias("map"))
    return out.join(images, "slice").join(boxes, "slice").withColumn("gated", F.col("n_images") >= GATED_IMAGES)


_SIZES = [a for a in AREAS if a != "all"]


@plan("evaluation", views("samples", "gt", "det_baseline", recursive=True) + f", {sql_slices()}," + sql_match("baseline", THRESHOLDS, list(AREAS)) + f", {WEIGHTS}," + SQL_AP + f""",
m AS (SELECT scope AS slice, round(avg(ap) FILTER (WHERE area = 'all'), 9) AS map, round(avg(ap) FILTER (WHERE area = 'all' AND thr = 0.5e0), 9) AS map50, round(avg(ap) FILTER (WHERE area = 'all' AND thr = 0.75e0), 9) AS map75,
    {", ".join(f"round(avg(ap) FILTER (WHERE area = '{a}'), 9) AS map_{a}" for a in _SIZES)} FROM ap GROUP BY scope),
k AS (SELECT scope AS slice, cls, avg(ap) AS ap FROM ap WHERE area = 'all' GROUP BY scope, cls),
p AS (SELECT slice, string_agg(printf('%d:%.6f', cls, ap), ',' ORDER BY cls) AS per_class FROM k GROUP BY slice),
c AS (SELECT slice, count(*) AS n_images FROM slices GROUP BY slice), b AS (SELECT slice, count(*) AS n_gt FROM slices JOIN gt USING (image_id) GROUP BY slice)
SELECT slice, map, map50, map75, {", ".join(f"map_{a}" for a in _SIZES)}, per_class, n_images, n_gt, n_images >= {GATED_IMAGES} AS gated FROM m JOIN p USING (slice) JOIN c USING (slice) JOIN b USING (slice)""")
def evaluation(v: Views):
    """The whole summary of every slice, a row each, from one match and one pass over all areas."""
    rows = report.summary(v.det(), v.gt(), ap.slice_membership(v.samples()))
    line = F.array_join(F.transform("per_class", lambda e: F.concat(e["cls"].cast("string"), F.lit(":"), fixed(e["ap"]))), ",")
    return rows.withColumns({c: F.round(c, 9) for c in rows.columns if c.startswith("map")} | {"per_class": line})


def _sql_arm(model: str) -> str:
    own = views("samples", "gt", f"det_{model}", recursive=True) + f", {sql_slices()}," + sql_match(model, THRESHOLDS) + f", {WEIGHTS}," + SQL_AP
    return f"(SELECT '{model}' AS arm, " + ", ".join(f"round(avg(ap) FILTER (WHERE scope = '{x}'), 9) AS {x}" for x in ("overall", "day", "night", "dawn")) + f" FROM ({own} SELECT * FROM ap))"


@plan("ablation", f"SELECT * FROM {_sql_arm('baseline')} UNION ALL SELECT * FROM {_sql_arm('candidate')}")
def ablation(v: Views):
    weights = ap.slice_membership(v.dealt_samples())
    rows = ap.mean_ap(_ap_of_models(v, weights, _matches_of_models(v, weights, ("baseline", "candidate"))), "arm", "slice")
    return rows.groupBy("arm").pivot("slice", ["overall", "day", "night", "dawn"]).agg(F.round(F.first("map"), 9))
