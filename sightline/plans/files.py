"""Round trips through files, and small reports."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from sightline.functions.lineage import remove, shared_folder
from sightline.operators import decisions, modes
from sightline.plans.data import sql_take
from sightline.plans.failures import ITEMS, _items
from sightline.plans.oracle import views
from sightline.schema import CLASSES, LABELS
from sightline.sources import files, publishing
from sightline.sources.tables import Views

QUERIES, SQL = {}, {}


def plan(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def _folder(v: Views, name: str) -> str:
    path = f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, v.spark, path)
    return path


@plan(
    "manifest_round_trip",
    views("samples", "gt") + """ SELECT CAST(s.image_id AS VARCHAR) AS id, s.image_id || '.jpg' AS image, timeofday, weather, count(box_id) AS boxes, round(coalesce(sum((x2 - x1) * (y2 - y1)), 0), 3) AS area
FROM samples s LEFT JOIN gt ON gt.image_id = s.image_id GROUP BY s.image_id, timeofday, weather""",
)
def manifest_round_trip(v: Views):
    path = _folder(v, "manifest")
    files.write_manifest(files.as_samples(v.samples(), v.gt()), path)
    area = F.aggregate("boxes", F.lit(0.0), lambda s, b: s + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))
    return files.read_manifest(v.spark, path).select("id", "image", F.col("attrs.timeofday").alias("timeofday"), F.col("attrs.weather").alias("weather"), F.size("boxes").cast("long").alias("boxes"), F.round(area, 3).alias("area"))


NAMES = [*LABELS, "train"]
_SQL_CLASSES = "[" + ", ".join(str(CLASSES.index(LABELS[n])) if n in LABELS else "NULL" for n in NAMES) + "]"


@plan(
    "nested_records",
    views("samples", "gt") + f""", o AS (SELECT image_id, {_SQL_CLASSES}[box_id % {len(NAMES)} + 1] AS cls, greatest(x1 / 1280 * 1280, 0) AS a, greatest(y1 / 720 * 720, 0) AS b, least((x1 / 1280 + (x2 - x1) / 2560) * 1280, 1280) AS c, least((y1 / 720 + (y2 - y1) / 7200) * 720, 720) AS d FROM gt),
k AS (SELECT * FROM o WHERE cls IS NOT NULL AND c - a >= 4 AND d - b >= 4)
SELECT CAST(s.image_id AS VARCHAR) AS id, CASE timeofday WHEN 'day' THEN 'day' WHEN 'night' THEN 'night' ELSE 'undefined' END AS timeofday, weather, scene, count(cls) AS boxes, CAST(coalesce(sum(cls), 0) AS BIGINT) AS classes
FROM samples s LEFT JOIN k ON k.image_id = s.image_id GROUP BY s.image_id, timeofday, weather, scene""",
)
def nested_records(v: Views):
    label = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("box_id") % len(NAMES) + 1).cast("int"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    box = F.struct(label.alias("label"), F.array(F.col("x1") / 1280, F.col("y1") / 720, w / 2560, h / 7200).alias("bounding_box"))
    held = v.gt().groupBy("image_id").agg(F.collect_list(box).alias("d"))
    named = lambda c: F.struct(c.alias("label"))
    time = F.when(F.col("timeofday") == "day", "daytime").otherwise(F.col("timeofday"))
    rows = v.samples().join(held, "image_id", "left").select(
        F.concat(F.lit("some/folder/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("filepath"), F.struct(F.lit(0).alias("width"), F.lit(None).cast("int").alias("height")).alias("metadata"),
        named(time).alias("timeofday"), named(F.replace("weather", F.lit("_"), F.lit(" "))).alias("weather"), named(F.replace("scene", F.lit("_"), F.lit(" "))).alias("scene"), F.struct(F.col("d").alias("detections")).alias("detections"),
    )
    path = _folder(v, "records")
    rows.select(F.array(F.struct("*")).alias("samples")).write.json(path)  # many small documents
    schema = f"samples array<{files.RECORD.simpleString()}>"
    records = v.spark.read.schema(schema).json(path).select(F.explode("samples").alias("r")).select("r.*")
    out = files.normalized(records, "images")
    classes = F.aggregate("boxes", F.lit(0).cast("long"), lambda s, b: s + b["cls"])
    return out.select("id", *[F.col("attrs")[c].alias(c) for c in ("timeofday", "weather", "scene")], F.size("boxes").cast("long").alias("boxes"), classes.alias("classes"))


@plan("predictions_round_trip", views("det_candidate") + " SELECT cls, count(*) AS n, round(sum(score), 6) AS score FROM det_candidate GROUP BY cls")
def predictions_round_trip(v: Views):
    path = _folder(v, "predictions")
    for model in ("baseline", "candidate"):
        files.write_predictions(v.det(model), model, path)
    return files.read_predictions(v.spark, path, "candidate").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score"))


@plan("split_scan", views("samples") + ", night AS (SELECT * FROM samples WHERE timeofday = 'night'), " + sql_take("taken", "night", 40, files.LIMIT_SEED) + " SELECT image_id, weather FROM taken ORDER BY image_id LIMIT 40")
def split_scan(v: Views):
    path = _folder(v, "splits")
    files.write_splits(v.samples().select("image_id", F.col("timeofday").alias("split")), path)
    return files.read_split(v.spark, path, "night", v.samples(), 40).select("image_id", "weather")


@plan(
    "cluster_counts",
    ITEMS + """, e AS (SELECT cluster, CAST(cls AS VARCHAR) AS value FROM items WHERE is_error AND cluster <> -1), c AS (SELECT cluster, value, count(*) AS n FROM e GROUP BY cluster, value)
SELECT * FROM (SELECT cluster, value, n, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 4""",
)
def cluster_counts(v: Views):
    return modes.cluster_counts(_items(v), "cls", top=4).select("cluster", "value", "n", "rank")


@plan("cluster_examples", ITEMS + " SELECT cluster, vec_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY vec_id) AS r FROM items WHERE is_error AND cluster <> -1) WHERE r <= 12")
def cluster_examples(v: Views):
    return modes.examples(_items(v), "vec_id").select("cluster", "vec_id", "rank")


@plan("cluster_means", "WITH i AS (SELECT event_id % 7 - 1 AS cluster, value FROM events), s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM i) SELECT cluster, round(avg((value - m) / (d + 1e-6)), 6) AS value FROM i, s WHERE cluster <> -1 GROUP BY cluster")
def cluster_means(v: Views):
    items = modes.standardize(v.table("events").select((F.col("event_id") % 7 - 1).alias("cluster"), "value"), ["value"])
    return modes.mean_features(items, ["value"]).select("cluster", F.round("value", 6).alias("value"))


@plan("latest_runs", "SELECT event_type AS name, max(ts) AS started, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS run, count(*) AS runs FROM events GROUP BY event_type")
def latest_runs(v: Views):
    return decisions.latest_runs(v.table("events").select(F.col("event_type").alias("name"), F.col("ts").alias("started"), F.col("event_id").alias("run")))


@plan("drift_sample", "SELECT event_id FROM events ORDER BY substr(sha256('0:' || event_id), 1, 16), event_id LIMIT 500")
def drift_sample(v: Views):
    return decisions.hash_sample(v.table("events").select("event_id"), "event_id", 500)


@plan("replay_sample", "SELECT event_id FROM events WHERE CAST(('0x' || substr(sha256('0:' || event_id), 1, 8)) AS BIGINT) / 4294967296.0e0 < 0.2e0")
def replay_sample(v: Views):
    return decisions.replay_sample(v.table("events").select("event_id"), "event_id", 0.2)


@plan("trigger", "SELECT event_id, concat_ws(',', CASE WHEN value > 50 THEN 'drift' END, CASE WHEN event_type = 'error' THEN 'slo' END, CASE WHEN event_id % 97 = 0 THEN 'forced' END) AS reasons, coalesce(value > 50, false) OR event_type = 'error' OR event_id % 97 = 0 AS triggered FROM events")
def trigger(v: Views):
    rows = v.table("events").select("event_id", (F.col("value") > 50).alias("drifted"), (F.col("event_type") == "error").alias("violated"), (F.col("event_id") % 97 == 0).alias("forced"))
    return decisions.trigger(rows).select("event_id", F.array_join("reasons", ",").alias("reasons"), "triggered")


@plan(
    "published_run",
    """WITH t AS (SELECT 'eval/' || event_type || '.json' AS file, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY event_type
UNION ALL SELECT 'status.json', count(*), round(sum(value), 6) FROM events)
SELECT *, '<workspace>/runs/' || file AS path, CASE WHEN file <> 'status.json' THEN 'best.pt' END AS weights, false AS with_pid FROM t""",
)
def published_run(v: Views):
    """A run's evaluations by type of event and its status are written with a private note, published, and read back."""
    run, target, home = _folder(v, "run"), _folder(v, "published"), "/home/someone/work space"
    total = [F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total")]
    found = v.table("events").groupBy(F.concat(F.lit("eval/"), "event_type", F.lit(".json")).alias("file")).agg(*total)
    whole = v.table("events").agg(*total).select(F.lit("status.json").alias("file"), "events", "total")
    path, model = F.concat(F.lit(f"{home}/runs/"), "file").alias("path"), F.struct(F.lit(f"{home}/weights/best.pt").alias("weights")).alias("model")
    texts = found.select("file", F.to_json(F.struct("events", "total", path, model)).alias("text"))
    texts = texts.unionByName(whole.select("file", F.to_json(F.struct(F.lit(4711).alias("pid"), "events", "total", path)).alias("text")))
    texts = texts.unionByName(v.spark.range(1).select(F.lit("notes/private.json").alias("file"), F.lit("{}").alias("text")))
    publishing.write_texts(texts, run)
    publishing.publish(v.spark, run, target, {home: "<workspace>"})
    schema = "events long, total double, path string, model struct<weights: string>"
    rows = publishing.read_texts(v.spark, target).select("file", F.from_json("text", schema).alias("r"), F.contains("text", F.lit("pid")).alias("with_pid"))
    return rows.select("file", "r.events", "r.total", "r.path", F.col("r.model.weights").alias("weights"), "with_pid")
