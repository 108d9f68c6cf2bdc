"""Result tables as JSON artifacts with a schema, a gate that is decided again from its stored tables, and manifests that meet a listing of images."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import files
from sightline.operators import decisions

#: The tables that a gate is decided from, and its result.
GATE = ("deltas", "base", "cand")


def _finite(column: Column, kind: T.DataType) -> Column:
    """NaN and infinite numbers as null, at any depth of lists and structs: JSON has no others."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, x: _finite(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[_finite(column[f.name], f.dataType).alias(f.name) for f in kind]))
    return column


def write_artifact(df: DataFrame, path: str) -> None:
    """JSON lines and the schema beside them; the folder appears once and complete, and is never written over."""
    spark = df.sparkSession
    staged = files.staging(path.rpartition("/")[0] or ".")
    df.select(*[_finite(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).write.option("ignoreNullFields", False).json(f"{staged}/rows")
    files.write_text(spark, f"{staged}/schema.json", df.schema.json())
    if not files.publish(spark, staged, path):
        raise ValueError(f"{path} exists already")


def read_artifact(spark: SparkSession, path: str, expected: T.StructType | None = None) -> DataFrame:
    """The rows as they were typed. A stored schema other than the expected one (names and types, in order) raises, and so does a row that does not fit it."""
    text = "\n".join(r.value for r in spark.read.text(f"{path}/schema.json").collect())  # one small file
    schema = T.StructType.fromJson(json.loads(text))
    shape = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
    if expected is not None and shape(schema) != shape(expected):
        raise ValueError(f"{path} has {schema.simpleString()} instead of {expected.simpleString()}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/rows")


def write_gate(deltas: DataFrame, base: DataFrame, cand: DataFrame, targets: list[str], path: str) -> DataFrame:
    """Decides the gate and stores what it was decided from with its checks; returns the checks as stored."""
    for name, table in zip(GATE, (deltas, base, cand), strict=True):
        write_artifact(table, f"{path}/{name}")
    write_artifact(gate_again(deltas.sparkSession, path, targets), f"{path}/checks")
    return read_artifact(deltas.sparkSession, f"{path}/checks")


def gate_again(spark: SparkSession, path: str, targets: list[str]) -> DataFrame:
    """The gate's checks from the stored tables; nothing is evaluated again."""
    return decisions.gate_checks(*[read_artifact(spark, f"{path}/{name}") for name in GATE], targets)


def listed(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """path and name of all images below a folder. Only names are listed: the column of bytes is never read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def with_images(samples: DataFrame, listing: DataFrame) -> DataFrame:
    """Samples whose image is listed, with its listed path; others drop. Of images of one name, the smallest path counts."""
    one = listing.groupBy("name").agg(F.min("path").alias("_path"))
    named = samples.withColumn("name", F.element_at(F.split("image", "/"), -1))
    return named.join(one, "name").withColumn("image", F.col("_path")).select(*samples.columns)


def resolved(samples: DataFrame, manifest: str) -> DataFrame:
    """Relative image paths as seen from the manifest's folder; absolute ones and those with a scheme stay."""
    folder = manifest.rstrip("/").rpartition("/")[0]
    absolute = F.col("image").startswith("/") | F.col("image").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return samples.withColumn("image", F.when(absolute, F.col("image")).otherwise(F.concat(F.lit(f"{folder}/"), F.regexp_replace("image", r"^(\./)+", ""))))
