"""The document of an evaluation: accuracy by slice, class and size, and the errors behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.lineage import stored
from sightline.operators import average_precision, match, tide
from sightline.schema import AREAS, GATED_IMAGES, THRESHOLDS

#: Slices whose errors are counted apart.
TIMES = ("day", "night", "dawn")


def summary(det: DataFrame, gt: DataFrame, members: DataFrame) -> DataFrame:
    """A row a slice that has an image: map, map50, map75, map_small, map_medium, map_large, per_class (list of cls, ap), n_images, n_gt, gated.

    `members` has image_id and slice. All areas are matched in one walk and their precision is taken in one pass, for all slices. A size, or a slice, without boxes has
    no number (null) and no classes.
    """
    areas = list(AREAS)
    found = stored(match.match_masks(det, gt, THRESHOLDS, areas))  # read for ranges and again inside them
    sized = found.select("image_id", "det_id", "cls", "score", F.inline(F.array(*[F.struct(F.lit(a).alias("area"), F.col(a).alias("result")) for a in areas])))
    table = average_precision.ap_table(sized, match.positives(gt, areas), members, THRESHOLDS, "result", by=["area", "cls"])
    # one row a slice, area and class, so classes and means come from one small aggregate
    near = lambda t: F.avg(F.when(F.abs(F.col("thr") - t) < 1e-9, F.col("ap")))
    classes = table.groupBy("slice", "area", "cls").agg(F.avg("ap").alias("ap"), near(0.5).alias("ap50"), near(0.75).alias("ap75"))
    of = lambda area, c: F.when(F.col("area") == area, F.col(c))
    maps = classes.groupBy("slice").agg(
        F.avg(of("all", "ap")).alias("map"), F.avg(of("all", "ap50")).alias("map50"), F.avg(of("all", "ap75")).alias("map75"),
        *[F.avg(of(a, "ap")).alias(f"map_{a}") for a in areas if a != "all"],
        F.sort_array(F.collect_list(F.when(F.col("area") == "all", F.struct("cls", "ap")))).alias("per_class"),
    )
    boxes = gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = members.join(boxes, "image_id", "left").groupBy("slice").agg(F.count(F.lit(1)).alias("n_images"), F.sum(F.coalesce("_n", F.lit(0))).alias("n_gt"))
    rows = counts.join(maps, "slice", "left").withColumn("gated", F.col("n_images") >= GATED_IMAGES)
    return rows.select("slice", *[c for c in maps.columns if c != "slice"], "n_images", "n_gt", "gated")


def errors(samples: DataFrame, det: DataFrame, gt: DataFrame, conf: float = 0.25) -> DataFrame:
    """Error counts of all images (slice overall) and of each time of day, in one aggregate over the records."""
    times = {"overall": "true"} | {t: f"timeofday = '{t}'" for t in TIMES}
    found = tide.records(samples, det, gt, conf).join(average_precision.slice_membership(samples, times), "image_id")
    return tide.summary(found, "slice")


def document(samples: DataFrame, det: DataFrame, gt: DataFrame, conf: float = 0.25) -> DataFrame:
    """The summary of every slice, with the error counts (a struct `errors`) of those that have them."""
    rows = summary(det, gt, average_precision.slice_membership(samples))
    counted = errors(samples, det, gt, conf)
    held = counted.select("slice", F.struct(*[c for c in counted.columns if c != "slice"]).alias("errors"))
    return rows.join(held, "slice", "left")
