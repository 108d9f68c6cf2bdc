"""Cluster statistics, concept enrichment, failure modes and targets over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import modes
from sightline.schema import CONDITIONS, OBJECT_CONCEPTS, SCENE_CONCEPTS
from sightline.sources.tables import Views

QUERIES, SQL = {}, {}


def plan(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def _items(v: Views):
    e = v.table("embeddings")
    error = F.col("vec_id") % 7 < F.col("label")
    return e.select("vec_id", "embedding", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"), error.alias("is_error"), F.when(error, 1.0).otherwise(2.0).alias("weight"), (F.col("vec_id") % 8).alias("cls"))


def _concepts(v: Views, names: list[str], first: int):
    e = v.table("embeddings").filter(F.col("vec_id").between(first, first + len(names) - 1))
    return e.select(F.element_at(F.array(*map(F.lit, names)), (F.col("vec_id") - first + 1).cast("int")).alias("concept"), "embedding")


def _sql_zero(name: str, names: list[str], first: int) -> str:
    return f"""{name}_c AS (SELECT {names!r}[vec_id - {first} + 1] AS concept, embedding FROM embeddings WHERE vec_id BETWEEN {first} AND {first + len(names) - 1}),
{name}_z AS (SELECT e.vec_id, c.concept, 30.0e0 * list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE))) AS z FROM embeddings e, {name}_c c),
{name}_t AS (SELECT vec_id, max(z) AS top FROM {name}_z GROUP BY vec_id),
{name} AS (SELECT vec_id, concept, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY vec_id) AS p FROM {name}_z JOIN {name}_t USING (vec_id)),
{name}_e AS (SELECT cluster, concept, own / base AS enrichment FROM (SELECT cluster, concept, avg(p) AS own FROM {name} JOIN items USING (vec_id) WHERE cluster <> -1 GROUP BY cluster, concept) JOIN (SELECT concept, avg(p) + 1e-9 AS base FROM {name} GROUP BY concept) USING (concept))"""


ITEMS = "WITH items AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster, vec_id % 7 < label AS is_error, CASE WHEN vec_id % 7 < label THEN 1.0e0 ELSE 2.0e0 END AS weight, vec_id % 8 AS cls FROM embeddings)"
STATS = """, tot AS (SELECT count(*) FILTER (WHERE is_error) / sum(weight) AS overall FROM items),
cs AS (SELECT cluster, count(*) AS size, count(*) FILTER (WHERE is_error) AS errors, sum(weight) AS w FROM items WHERE cluster <> -1 GROUP BY cluster),
stats AS (SELECT cluster, size, errors, errors / w AS error_rate, CASE WHEN overall > 0 THEN errors / w / overall ELSE 0 END AS lift, errors - overall * w AS excess_errors FROM cs, tot)"""


def _sql_top(name: str, n: int) -> str:
    return f"(SELECT cluster, list(concept ORDER BY r) FILTER (WHERE enrichment > {modes.ENRICHED}e0) AS c FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY enrichment DESC, concept) AS r FROM {name}_e) WHERE r <= {n} GROUP BY cluster)"


MODES = ITEMS + STATS + ", " + _sql_zero("scene", SCENE_CONCEPTS, 0) + ", " + _sql_zero("obj", OBJECT_CONCEPTS, 9) + f""",
named AS (SELECT stats.*, coalesce(s.c, []) AS top_scene, coalesce(o.c, []) AS top_object FROM stats LEFT JOIN {_sql_top("scene", 3)} s USING (cluster) LEFT JOIN {_sql_top("obj", 2)} o USING (cluster)),
flagged AS (SELECT *, lift >= {modes.MIN_LIFT}e0 AND excess_errors > 0 AS is_mode, list_concat(top_scene[1:2], top_object[1:1]) AS bits, list_filter(top_scene, lambda x: list_contains({CONDITIONS!r}, x))[1] AS condition FROM named),
modes AS (SELECT *, CASE WHEN len(bits) > 0 THEN array_to_string(bits, ' / ') ELSE 'generic' END AS name, CASE WHEN is_mode THEN row_number() OVER (PARTITION BY is_mode ORDER BY excess_errors DESC, cluster) END AS rank FROM flagged)"""


def _modes(v: Views):
    items = _items(v)
    scene = modes.enrichment(items, modes.zero_shot(items, _concepts(v, SCENE_CONCEPTS, 0)))
    objects = modes.enrichment(items, modes.zero_shot(items, _concepts(v, OBJECT_CONCEPTS, 9)))
    return modes.failure_modes(modes.cluster_stats(items), modes.top_concepts(scene, 3, "top_scene"), modes.top_concepts(objects, 2, "top_object"))


@plan("standardize", "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) SELECT event_id, round((value - m) / (d + 1e-6), 6) AS z FROM events, s")
def standardize(v: Views):
    return modes.standardize(v.table("events").select("event_id", "value"), ["value"]).select("event_id", F.round("value", 6).alias("z"))


@plan("zero_shot", ITEMS + ", " + _sql_zero("scene", SCENE_CONCEPTS, 0) + " SELECT vec_id, concept, round(p, 9) AS p FROM scene")
def zero_shot(v: Views):
    return modes.zero_shot(_items(v), _concepts(v, SCENE_CONCEPTS, 0)).withColumn("p", F.round("p", 9))


@plan("enrichment", ITEMS + ", " + _sql_zero("scene", SCENE_CONCEPTS, 0) + " SELECT cluster, concept, round(enrichment, 6) AS enrichment FROM scene_e")
def enrichment(v: Views):
    items = _items(v)
    return modes.enrichment(items, modes.zero_shot(items, _concepts(v, SCENE_CONCEPTS, 0))).withColumn("enrichment", F.round("enrichment", 6))


@plan("cluster_stats", ITEMS + STATS + " SELECT cluster, size, errors, round(error_rate, 9) AS error_rate, round(lift, 9) AS lift, round(excess_errors, 9) AS excess_errors FROM stats")
def cluster_stats(v: Views):
    s = modes.cluster_stats(_items(v))
    return s.select("cluster", "size", "errors", *[F.round(c, 9).alias(c) for c in ("error_rate", "lift", "excess_errors")])


@plan("noise_fraction", ITEMS + " SELECT round(avg(CASE WHEN cluster = -1 THEN 1.0e0 ELSE 0.0e0 END), 9) AS noise FROM items")
def noise_fraction(v: Views):
    return _items(v).agg(F.round(F.avg((F.col("cluster") == -1).cast("double")), 9).alias("noise"))


@plan("failure_modes", MODES + " SELECT cluster, name, coalesce(condition, '') AS condition, is_mode, coalesce(rank, 0) AS rank, round(excess_errors, 9) AS excess_errors FROM modes")
def failure_modes(v: Views):
    return _modes(v).select("cluster", "name", F.coalesce("condition", F.lit("")).alias("condition"), "is_mode", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"), F.round("excess_errors", 9).alias("excess_errors"))


@plan("targets", MODES + f""", chosen AS (SELECT * FROM modes WHERE is_mode AND condition IS NOT NULL ORDER BY rank LIMIT {modes.TOP_MODES}),
cc AS (SELECT cluster, cls, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, cls) AS r FROM items GROUP BY cluster, cls)
SELECT cluster, condition, rank, (SELECT string_agg(CAST(cls AS VARCHAR), ',' ORDER BY r) FROM cc WHERE cc.cluster = chosen.cluster AND r <= 4) AS classes FROM chosen""")
def targets(v: Views):
    found = modes.targets(_modes(v), _items(v).select("cluster", "cls"))
    return found.select("cluster", "condition", F.col("rank").cast("long").alias("rank"), F.array_join(F.transform("classes", lambda c: c.cast("string")), ",").alias("classes"))
