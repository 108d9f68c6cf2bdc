"""Readers and writers of manifests, nested label records, predictions and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.files import exists
from sightline.operators.splits import stratified_take
from sightline.schema import CLASSES, LABELS, SAMPLE, TIMES_OF_DAY

#: Least side of a box that is kept, in pixels; size of an image that names none; seed of a split's limited selection.
MIN_SIDE, SIZE, LIMIT_SEED = 4.0, (1280, 720), 7
UNDEFINED = "undefined"

_LABEL = T.StructType([T.StructField("label", T.StringType())])
_OBJECT = T.StructType([T.StructField("label", T.StringType()), T.StructField("bounding_box", T.ArrayType(T.DoubleType()))])
RECORD = T.StructType(
    [
        T.StructField("filepath", T.StringType()),
        T.StructField("metadata", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])),
        *[T.StructField(c, _LABEL) for c in ("timeofday", "weather", "scene")],
        T.StructField("detections", T.StructType([T.StructField("detections", T.ArrayType(_OBJECT))])),
    ]
)


def as_samples(samples: DataFrame, gt: DataFrame) -> DataFrame:
    """Rows in the form of SAMPLE from flat images (image_id, width, height, attributes) and boxes."""
    box = F.struct("box_id", "cls", "x1", "y1", "x2", "y2", F.lit(False).alias("occluded"), F.lit(False).alias("truncated"))
    held = gt.groupBy("image_id").agg(F.sort_array(F.collect_list(box)).alias("b"))
    named = ("timeofday", "weather", "scene")
    attrs = F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*[F.col(c) for c in named]))
    bare = F.transform(F.coalesce("b", F.array().cast(held.schema["b"].dataType)), lambda x: x.dropFields("box_id"))
    name = F.col("image_id").cast("string")
    return samples.join(held, "image_id", "left").select(name.alias("id"), F.concat(name, F.lit(".jpg")).alias("image"), "width", "height", bare.alias("boxes"), attrs.alias("attrs"))


def write_manifest(samples: DataFrame, path: str) -> int:
    """One JSON object a line; the number of rows written. Spark's committer makes the folder whole or not at all."""
    from pyspark.sql import Observation

    seen = Observation("manifest")
    samples.select(*SAMPLE.names).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a manifest; blank lines are skipped. A line that is no sample raises an error with its file and number."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    schema = T.StructType([*SAMPLE.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("s"), "_metadata.file_path")
    broken = F.col("s").isNull() | F.col("s._bad").isNotNull() | F.col("s.id").isNull()
    first = parsed.filter(broken).select("file_path").limit(1).collect()
    if first:
        raise ValueError(f"bad sample in {first[0].file_path}, line {_bad_line(spark, first[0].file_path, schema)}")
    return parsed.select("s.*").drop("_bad")


def _bad_line(spark: SparkSession, file: str, schema: T.StructType) -> int:
    """The number of the first bad line of one file; read again only once an error is certain."""
    lines = spark.read.text(file).withColumn("at", F.monotonically_increasing_id())
    s = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})
    bad = lines.filter((F.trim("value") != "") & (s.isNull() | s["_bad"].isNotNull() | s["id"].isNull()))
    at = bad.agg(F.min("at")).first()[0]
    return lines.filter(F.col("at") <= at).count()


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def normalized(records: DataFrame, root: str, min_side: float = MIN_SIDE) -> DataFrame:
    """Samples from nested records: known labels as classes, boxes in pixels cut to the image, small ones left out, attributes named."""
    width, height = (F.when(F.col(f"metadata.{c}") > 0, F.col(f"metadata.{c}")).otherwise(d) for c, d in zip(("width", "height"), SIZE, strict=True))
    rows = records.withColumns({"width": width, "height": height, "name": F.element_at(F.split("filepath", "/"), -1)})
    classes = _map({label: CLASSES.index(c) for label, c in LABELS.items()})

    def box(d):
        x, y, w, h = (d["bounding_box"][k] for k in range(4))
        edge = lambda v, size: F.least(F.greatest(v * F.col(size), F.lit(0.0)), F.col(size).cast("double"))
        return F.struct(
            F.try_element_at(classes, d["label"]).alias("cls"), edge(x, "width").alias("x1"), edge(y, "height").alias("y1"), edge(x + w, "width").alias("x2"), edge(y + h, "height").alias("y2"),
            F.lit(False).alias("occluded"), F.lit(False).alias("truncated"),
        )

    objects = F.coalesce("detections.detections", F.array().cast(T.ArrayType(_OBJECT)))
    boxes = F.filter(F.transform(objects, box), lambda b: b["cls"].isNotNull() & (b["x2"] - b["x1"] >= min_side) & (b["y2"] - b["y1"] >= min_side))
    edges = ("x1", "y1", "x2", "y2")
    boxes = F.transform(boxes, lambda b: F.struct(b["cls"].alias("cls"), *[F.bround(b[e], 2).alias(e) for e in edges], b["occluded"].alias("occluded"), b["truncated"].alias("truncated")))
    tag = lambda c: F.coalesce(F.replace(F.col(f"{c}.label"), F.lit(" "), F.lit("_")), F.lit(UNDEFINED))
    time = F.coalesce(F.try_element_at(_map(TIMES_OF_DAY), F.col("timeofday.label")), F.lit(UNDEFINED))
    attrs = F.map_from_arrays(F.array(*map(F.lit, ("timeofday", "weather", "scene", "source"))), F.array(time, tag("weather"), tag("scene"), F.lit("real")))
    return rows.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("id"), F.concat(F.lit(root.rstrip("/") + "/"), "name").alias("image"), "width", "height", boxes.alias("boxes"), attrs.alias("attrs"))


def read_records(spark: SparkSession, path: str, root: str, min_side: float = MIN_SIDE) -> DataFrame:
    """Samples of a document {"samples": [record, ...]}. Such a document is one JSON value, and so is read by one task a file."""
    schema = T.StructType([T.StructField("samples", T.ArrayType(RECORD))])
    records = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("samples").alias("r")).select("r.*")
    return normalized(records, root, min_side)


def write_predictions(det: DataFrame, model: str, path: str) -> None:
    """Detections of a model in a folder of its own; another model's stay."""
    det.write.mode("overwrite").parquet(f"{path}/model={model}")


def read_predictions(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Detections of one model; others are not read."""
    return spark.read.parquet(path).filter(F.col("model") == model).drop("model")


def arm_extra(spark: SparkSession, path: str, arm: str, schema: T.StructType) -> DataFrame:
    """The extra training samples of one arm, from a table partitioned by arm; none, if there is no such table or arm (a plain fine-tuning has none)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("arm", T.StringType())])).parquet(path).filter(F.col("arm") == arm).drop("arm")


def write_splits(splits: DataFrame, path: str) -> None:
    splits.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, name: str, samples: DataFrame, limit: int = 0) -> DataFrame:
    """Samples of one split; with a limit, so many of a stratified selection, in image order."""
    wanted = spark.read.parquet(path).filter(F.col("split") == name).select("image_id")
    rows = samples.join(wanted, "image_id", "left_semi")
    if limit <= 0:
        return rows
    return stratified_take(rows, limit, LIMIT_SEED).orderBy("image_id").limit(limit)

