"""Error typing and failure mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import average_precision, mining, tide
from sightline.plans.evaluation import sql_match, sql_slices
from sightline.plans.oracle import IOU, views
from sightline.sources.tables import Views

QUERIES, SQL = {}, {}


def plan(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def sql_records(model: str) -> str:
    walk = sql_match("conf", [0.5]).replace("coalesce(hit_inside, false) AS tp", "hit, coalesce(hit_inside, false) AS tp")
    return views("samples", "gt", f"det_{model}", recursive=True) + f""",
det_conf AS (SELECT * FROM det_{model} WHERE score >= 0.25e0),{walk},
pairs AS (SELECT d.image_id, d.det_id, d.score, g.box_id, g.cls AS gcls, d.cls = g.cls AS same, {IOU} AS iou FROM det_conf d JOIN gt g ON d.image_id = g.image_id),
near AS (SELECT image_id, det_id, list(struct_pack(iou := iou, box_id := box_id, cls := gcls) ORDER BY iou DESC, box_id) FILTER (WHERE same) AS s,
    list(struct_pack(iou := iou, box_id := box_id, cls := gcls) ORDER BY iou DESC, box_id) FILTER (WHERE NOT same) AS o FROM pairs GROUP BY image_id, det_id),
base AS (SELECT m.image_id, m.det_id, m.cls, m.score, m.hit, coalesce(s[1].iou, 0) AS si, coalesce(o[1].iou, 0) AS oi, s[1] AS sb, o[1] AS ob, p.iou AS hit_iou
    FROM matched m LEFT JOIN near n ON n.image_id = m.image_id AND n.det_id = m.det_id LEFT JOIN pairs p ON p.image_id = m.image_id AND p.det_id = m.det_id AND p.box_id = m.hit),
typed AS (SELECT *, CASE WHEN hit IS NOT NULL THEN 'tp' WHEN si >= 0.5e0 THEN 'dupe' WHEN oi >= 0.5e0 THEN 'cls' WHEN si >= 0.1e0 THEN 'loc' WHEN oi >= 0.1e0 THEN 'both' ELSE 'bkg' END AS kind FROM base),
found AS (SELECT image_id, kind, det_id, CASE kind WHEN 'tp' THEN hit WHEN 'loc' THEN sb.box_id WHEN 'cls' THEN ob.box_id WHEN 'both' THEN ob.box_id END AS box_id, cls, score,
    CASE kind WHEN 'tp' THEN hit_iou WHEN 'dupe' THEN si WHEN 'loc' THEN si WHEN 'bkg' THEN greatest(si, oi) ELSE oi END AS iou,
    CASE kind WHEN 'tp' THEN cls WHEN 'loc' THEN cls WHEN 'cls' THEN ob.cls WHEN 'both' THEN ob.cls ELSE -1 END AS gt_cls, '' AS covered_by FROM typed),
missed AS (SELECT g.image_id, 'miss' AS kind, CAST(NULL AS BIGINT) AS det_id, g.box_id, g.cls, 0.0e0 AS score,
    coalesce((SELECT max(iou) FROM pairs p WHERE p.image_id = g.image_id AND p.box_id = g.box_id), 0) AS iou, g.cls AS gt_cls,
    coalesce((SELECT arg_min(f.kind, struct_pack(a := -f.score, b := f.det_id)) FROM found f WHERE f.image_id = g.image_id AND f.box_id = g.box_id AND f.kind IN ('cls', 'loc', 'both')), '') AS covered_by
    FROM gt g ANTI JOIN (SELECT image_id, hit AS box_id FROM typed WHERE hit IS NOT NULL) t ON t.image_id = g.image_id AND t.box_id = g.box_id),
records AS (SELECT * FROM found UNION ALL SELECT * FROM missed)"""


def sql_summary(group: str = "") -> str:
    c = lambda k: f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT)"
    made, real = "count(*) FILTER (WHERE kind <> 'miss')", "count(*) FILTER (WHERE kind IN ('tp', 'miss'))"
    share = lambda n: f"round(CASE WHEN {n} > 0 THEN {c('tp')} / {n} ELSE 0.0e0 END, 9)"
    return ", ".join(f'{c(k)} AS "{k}"' for k in tide.KINDS) + f", count(*) FILTER (WHERE kind = 'miss' AND covered_by = '') AS miss_uncovered, {real} AS n_gt, {share(made)} AS precision, {share(real)} AS recall"


@plan("tide_records", sql_records("noisy") + " SELECT image_id, kind, coalesce(det_id, -1) AS det_id, coalesce(box_id, -1) AS box_id, cls, score, round(iou, 9) AS iou, gt_cls, covered_by FROM records")
def tide_records(v: Views):
    found = tide.records(v.samples(), v.det("noisy"), v.gt())
    return found.drop("x1", "y1", "x2", "y2").withColumns({"iou": F.round("iou", 9), "det_id": F.coalesce("det_id", F.lit(-1)), "box_id": F.coalesce("box_id", F.lit(-1))})


@plan("tide_summary", sql_records("baseline") + f" SELECT {sql_summary()} FROM records")
def tide_summary(v: Views):
    return tide.summary(tide.records(v.samples(), v.det(), v.gt()))


@plan("tide_by_slice", sql_records("noisy") + f", {sql_slices()} SELECT slice, {sql_summary()} FROM records JOIN slices USING (image_id) WHERE slice IN ('day', 'night', 'dawn') GROUP BY slice")
def tide_by_slice(v: Views):
    found = tide.records(v.samples(), v.det("noisy"), v.gt())
    members = average_precision.slice_membership(v.samples(), {n: f"timeofday = '{n}'" for n in ("day", "night", "dawn")})
    return tide.summary(found.join(members, "image_id"), "slice")


def sql_mined(errors: int, tps: int) -> str:
    return sql_records("noisy") + f""",
own AS (SELECT r.*, coalesce(r.det_id, r.box_id) AS own, coalesce(d.x1, g.x1) AS x1, coalesce(d.y1, g.y1) AS y1, coalesce(d.x2, g.x2) AS x2, coalesce(d.y2, g.y2) AS y2
    FROM records r LEFT JOIN det_noisy d ON r.kind <> 'miss' AND d.image_id = r.image_id AND d.det_id = r.det_id LEFT JOIN gt g ON r.kind = 'miss' AND g.image_id = r.image_id AND g.box_id = r.box_id),
kept AS (SELECT *, substr(sha256(concat_ws(':', '0', image_id, kind, own)), 1, 16) AS h FROM own WHERE kind <> 'dupe' AND least(x2 - x1, y2 - y1) >= 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind = 'tp' ORDER BY h, image_id, kind, own) AS rk, count(*) OVER (PARTITION BY kind = 'tp') AS n FROM kept),
mined AS (SELECT *, CASE WHEN kind = 'tp' THEN greatest(1.0e0, n / {tps}.0e0) ELSE 1.0e0 END AS weight, kind <> 'tp' AS is_error FROM ranked JOIN samples USING (image_id) WHERE rk <= CASE WHEN kind = 'tp' THEN {tps} ELSE {errors} END)"""


@plan("mined", sql_mined(6000, 3000) + " SELECT image_id, kind, own, is_error, round(weight, 9) AS weight, timeofday, weather FROM mined")
def mined(v: Views):
    m = mining.mine(v.samples(), v.det("noisy"), v.gt())
    return m.select("image_id", "kind", "own", "is_error", F.round("weight", 9).alias("weight"), "timeofday", "weather")


@plan("mining_weights", sql_mined(2000, 1000) + " SELECT kind, count(*) AS n, count(DISTINCT image_id) AS images, round(sum(weight), 6) AS weight FROM mined GROUP BY kind")
def mining_weights(v: Views):
    m = mining.mine(v.samples(), v.det("noisy"), v.gt(), max_errors=2000, tp_sample=1000)
    return m.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("images"), F.round(F.sum("weight"), 6).alias("weight"))


@plan("context_box", views("gt") + """, s AS (SELECT *, greatest(greatest(x2 - x1, y2 - y1) * (1 + 0.6e0), 24.0e0) AS side, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM gt),
c AS (SELECT image_id, box_id, CAST(trunc(greatest(0, cx - side / 2)) AS INTEGER) AS a, CAST(trunc(greatest(0, cy - side / 2)) AS INTEGER) AS b, CAST(trunc(least(1280, cx + side / 2)) AS INTEGER) AS c, CAST(trunc(least(720, cy + side / 2)) AS INTEGER) AS d FROM s)
SELECT image_id, box_id, a AS x1, b AS y1, greatest(c, a + 1) AS x2, greatest(d, b + 1) AS y2 FROM c""")
def context_box(v: Views):
    rows = v.gt().select("image_id", "box_id", F.struct("x1", "y1", "x2", "y2").alias("box"), F.lit(1280).alias("w"), F.lit(720).alias("h"))
    return rows.select("image_id", "box_id", mining.context_box("box", "w", "h").alias("c")).select("image_id", "box_id", "c.*")


@plan("photometric_geometry", views("gt") + """, r AS (SELECT image_id, box_id, greatest(CAST(round_even(x1, 0) AS INTEGER), 0) AS a, greatest(CAST(round_even(y1, 0) AS INTEGER), 0) AS b, CAST(round_even(x2, 0) AS INTEGER) AS x, CAST(round_even(y2, 0) AS INTEGER) AS y FROM gt),
q AS (SELECT image_id, box_id, a, b, least(greatest(x, a + 1), 1280) AS c, least(greatest(y, b + 1), 720) AS d FROM r)
SELECT image_id, box_id, round(ln(sqrt(greatest(c - a, 1) * greatest(d - b, 1)) / sqrt(1280 * 1280 + 720 * 720)), 9) AS log_size, round(ln(greatest(c - a, 1) / greatest(d - b, 1)), 9) AS aspect, round((b + d) / 2 / 720, 9) AS cy FROM q""")
def photometric_geometry(v: Views):
    rows = mining.geometry(v.gt().withColumns({"width": F.lit(1280), "height": F.lit(720)}))
    return rows.select("image_id", "box_id", *[F.round(c, 9).alias(c) for c in ("log_size", "aspect", "cy")])
