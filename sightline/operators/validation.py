"""Sanity checks of manifests, an order-independent digest, and label text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.decimals import fixed
from sightline.schema import CLASSES


def validate(samples: DataFrame, gt: DataFrame) -> DataFrame:
    """image_id and problem, a row for each: duplicate ids, sizes, classes, degenerate boxes, boxes beyond the image by over a pixel."""
    twice = samples.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("image_id", F.lit("duplicate id").alias("problem"))
    size = samples.filter("width <= 0 or height <= 0").select("image_id", F.lit("bad size").alias("problem"))
    rows = gt.join(samples.select("image_id", "width", "height").dropDuplicates(["image_id"]), "image_id")
    found = F.array_compact(
        F.array(
            F.when(~F.col("cls").between(0, len(CLASSES) - 1), F.lit("class out of range")),
            F.when(F.expr("x2 <= x1 or y2 <= y1"), F.lit("degenerate box")),
            F.when(F.expr("x1 < -1 or y1 < -1 or x2 > width + 1 or y2 > height + 1"), F.lit("box outside image")),
        )
    )
    return twice.unionByName(size).unionByName(rows.select("image_id", F.explode(found).alias("problem")))


def canonical_box(b: Column) -> Column:
    """One line of text for a box: class and corners with two decimals."""
    return F.format_string("%d %.2f %.2f %.2f %.2f", b["cls"], b["x1"], b["y1"], b["x2"], b["y2"])


def lines(samples: DataFrame, gt: DataFrame) -> DataFrame:
    """image_id and its canonical line: the id and its boxes in box order."""
    box = F.struct("box_id", canonical_box(F.struct("cls", "x1", "y1", "x2", "y2")).alias("t"))
    held = gt.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(box)), lambda x: x["t"]), ";").alias("boxes"))
    return samples.join(held, "image_id", "left").select("image_id", F.concat(F.col("image_id").cast("string"), F.lit("|"), F.coalesce("boxes", F.lit(""))).alias("line"))


def digest(samples: DataFrame, gt: DataFrame, parts: int = 256) -> DataFrame:
    """An order-independent digest in two levels: lines hash by the first byte of their own hash, and those hashes together.

    A level-one group holds 64-character line hashes, 1/256 of all; raise `parts` (a power of 16) for more than some ten million images.
    """
    width = {16: 1, 256: 2, 4096: 3, 65536: 4}[parts]
    hashed = lines(samples, gt).select(F.sha2("line", 256).alias("h"))
    first = hashed.groupBy(F.substring("h", 1, width).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    return first.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def label_lines(samples: DataFrame, gt: DataFrame, decimals: int = 6) -> DataFrame:
    """image_id and its label text: class, centre and size relative to the image (exact halves in the last decimal go to even), a line a box."""
    rows = gt.join(samples.select("image_id", "width", "height"), "image_id")
    of = lambda x, side: fixed(F.expr(x) / F.col(side), decimals)
    text = F.concat_ws(" ", F.col("cls").cast("string"), of("(x1 + x2) / 2", "width"), of("(y1 + y2) / 2", "height"), of("x2 - x1", "width"), of("y2 - y1", "height"))
    # text is made before the groups: inside an aggregate Spark would work out each repeated part of it again
    rows = rows.select("image_id", "box_id", text.alias("t"))
    held = rows.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("box_id", "t"))), lambda x: x["t"]), "\n").alias("labels"))
    return samples.select("image_id").join(held, "image_id", "left").select("image_id", F.coalesce("labels", F.lit("")).alias("labels"))
