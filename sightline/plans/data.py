"""Splits, validation, digests and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import splits, validation
from sightline.plans.oracle import views
from sightline.sources.tables import Views

QUERIES, SQL = {}, {}
SIZES = {"golden": {"day": 300, "night": 600, "dawn": 200}, "probe": {"day": 100, "night": 300, "dawn": 100}, "val_day": {"day": 400}, "train_day": {"day": 0}}
SEED = 2026


def plan(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def sql_take(name: str, source: str, n: int, seed: int) -> str:
    """Tables ending in `name` (image_id, group_id, ...): the stratified selection of n images from `source`."""
    if n <= 0:
        return f"{name} AS (SELECT * FROM {source} WHERE false)"
    h = lambda s, c: f"substr(sha256('{s}:' || {c}), 1, 16)"
    return f"""{name}_g AS (SELECT group_id, arg_min(coalesce(timeofday, '?') || '/' || coalesce(weather, '?'), image_id) AS cell, count(*) AS size FROM {source} GROUP BY group_id),
{name}_p AS (SELECT *, (row_number() OVER (PARTITION BY cell ORDER BY {h(seed, "group_id")}, group_id) - 0.5e0) / count(*) OVER (PARTITION BY cell) AS place FROM {name}_g),
{name}_r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY place, {h(seed + 1, "group_id")}, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_p),
{name} AS (SELECT * FROM {source} WHERE group_id IN (SELECT group_id FROM {name}_r WHERE before < {n}))"""


def sql_splits() -> str:
    out = [views("samples")]
    for tod in ("day", "night", "dawn"):
        out.append(f"u_{tod} AS (SELECT * FROM samples WHERE timeofday = '{tod}')")
        out.append(sql_take(f"golden_{tod}", f"u_{tod}", SIZES["golden"][tod], SEED))
    out.append("golden AS (SELECT * FROM golden_day UNION ALL SELECT * FROM golden_night UNION ALL SELECT * FROM golden_dawn)")
    out.append("l1 AS (SELECT * FROM samples WHERE timeofday IN ('day', 'night', 'dawn') AND group_id NOT IN (SELECT group_id FROM golden))")
    for tod in ("day", "night", "dawn"):
        out.append(f"l1_{tod} AS (SELECT * FROM l1 WHERE timeofday = '{tod}')")
        out.append(sql_take(f"probe_{tod}", f"l1_{tod}", SIZES["probe"][tod], SEED + 10))
    out.append("probe AS (SELECT * FROM probe_day UNION ALL SELECT * FROM probe_night UNION ALL SELECT * FROM probe_dawn)")
    out.append("l2 AS (SELECT * FROM l1 WHERE group_id NOT IN (SELECT group_id FROM probe)), l2_day AS (SELECT * FROM l2 WHERE timeofday = 'day')")
    out.append(sql_take("val_day", "l2_day", SIZES["val_day"]["day"], SEED + 20))
    out.append("l3 AS (SELECT * FROM l2 WHERE group_id NOT IN (SELECT group_id FROM val_day)), train_day AS (SELECT * FROM l3 WHERE timeofday = 'day')")
    out.append("target_pool AS (SELECT * FROM l3 WHERE group_id NOT IN (SELECT group_id FROM train_day) AND timeofday IN ('night', 'dawn'))")
    out.append("splits AS (" + " UNION ALL ".join(f"SELECT image_id, '{n}' AS split FROM {n}" for n in ("golden", "probe", "val_day", "train_day", "target_pool")) + ")")
    return ", ".join(out)


def _splits(v: Views):
    return splits.make_splits(v.samples(), SIZES, SEED)


@plan("stratified_take", views("samples") + ", night AS (SELECT * FROM samples WHERE timeofday = 'night'), " + sql_take("taken", "night", 600, SEED) + " SELECT image_id, weather FROM taken")
def stratified_take(v: Views):
    return splits.stratified_take(v.samples().filter("timeofday = 'night'"), 600, SEED).select("image_id", "weather")


@plan("make_splits", sql_splits() + " SELECT image_id, split FROM splits")
def make_splits(v: Views):
    return _splits(v)


@plan("canonical_splits", sql_splits() + f""" SELECT image_id, split, row_number() OVER (PARTITION BY split ORDER BY CASE WHEN split = 'golden' THEN '' ELSE substr(sha256('{SEED + 40}:' || image_id), 1, 16) END, image_id) - 1 AS pos FROM splits""")
def canonical_splits(v: Views):
    return splits.canonical(_splits(v), SEED).select("image_id", "split", "pos")


@plan("check_disjoint", sql_splits() + " SELECT group_id, count(DISTINCT split) AS n FROM splits JOIN samples USING (image_id) GROUP BY group_id HAVING count(DISTINCT split) > 1")
def check_disjoint(v: Views):
    return splits.check_disjoint(_splits(v), v.samples()).select("group_id", F.size("splits").cast("long").alias("n"))


@plan("leakage_anti_join", sql_splits() + " SELECT image_id FROM samples WHERE image_id NOT IN (SELECT image_id FROM splits)")
def leakage_anti_join(v: Views):
    return v.samples().join(_splits(v), "image_id", "left_anti").select("image_id")


@plan("describe_splits", sql_splits() + """, li AS (SELECT l_orderkey AS image_id, count(*) AS boxes FROM lineitem GROUP BY 1)
SELECT split, count(*) AS images, CAST(sum(coalesce(boxes, 0)) AS BIGINT) AS boxes, count(*) FILTER (WHERE timeofday = 'night') AS night, count(*) FILTER (WHERE weather = 'rainy') AS rainy
FROM splits JOIN samples USING (image_id) LEFT JOIN li USING (image_id) GROUP BY split""")
def describe_splits(v: Views):
    found = splits.describe(_splits(v), v.samples(), v.gt())
    count = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0))
    return found.select("split", "images", "boxes", count("by_timeofday", "night").alias("night"), count("by_weather", "rainy").alias("rainy"))


@plan("validate_samples", views("samples", "gt") + """, bent AS (SELECT image_id, box_id, CASE WHEN box_id % 7 = 0 THEN 99 ELSE cls END AS cls, x1, y1, CASE WHEN box_id % 5 = 0 THEN x1 ELSE x2 + 40 END AS x2, y2 FROM gt)
SELECT problem, count(*) AS n FROM (
    SELECT image_id, 'class out of range' AS problem FROM bent WHERE cls NOT BETWEEN 0 AND 7 UNION ALL SELECT image_id, 'degenerate box' FROM bent WHERE x2 <= x1 OR y2 <= y1
    UNION ALL SELECT image_id, 'box outside image' FROM bent WHERE x1 < -1 OR y1 < -1 OR x2 > 1281 OR y2 > 721
    UNION ALL SELECT image_id, 'duplicate id' FROM (SELECT image_id FROM samples UNION ALL SELECT image_id FROM samples WHERE image_id % 100 = 0) GROUP BY image_id HAVING count(*) > 1) GROUP BY problem""")
def validate_samples(v: Views):
    bent = v.gt().withColumns({"cls": F.when(F.col("box_id") % 7 == 0, 99).otherwise(F.col("cls")), "x2": F.when(F.col("box_id") % 5 == 0, F.col("x1")).otherwise(F.col("x2") + 40)})
    twice = v.samples().unionByName(v.samples().filter("image_id % 100 = 0"))
    return validation.validate(twice, bent).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


_LINES = """, lines AS (SELECT s.image_id, s.image_id || '|' || coalesce(b, '') AS line FROM samples s LEFT JOIN (SELECT image_id, string_agg(printf('%d %.2f %.2f %.2f %.2f', cls, x1, y1, x2, y2), ';' ORDER BY box_id) AS b FROM gt GROUP BY image_id) g ON g.image_id = s.image_id),
h AS (SELECT sha256(line) AS h FROM lines), p AS (SELECT substr(h, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY p)) AS digest FROM p"""


@plan("digest", views("samples", "gt") + _LINES)
def digest(v: Views):
    return validation.digest(v.samples(), v.gt())


@plan("label_lines", views("samples", "gt") + """ SELECT s.image_id, coalesce(string_agg(printf('%d %.6f %.6f %.6f %.6f', cls, (x1 + x2) / 2 / 1280, (y1 + y2) / 2 / 720, (x2 - x1) / 1280, (y2 - y1) / 720), chr(10) ORDER BY box_id), '') AS labels
FROM samples s LEFT JOIN gt ON gt.image_id = s.image_id GROUP BY s.image_id""")
def label_lines(v: Views):
    return validation.label_lines(v.samples(), v.gt())
