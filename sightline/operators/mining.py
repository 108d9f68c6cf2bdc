"""Failure mining: typed errors with their image's attributes, capped by a hash order, and a sample of true positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.hashing import prefix
from sightline.functions.lineage import stored
from sightline.operators import tide

MIN_SIDE = 2.0
MAX_ERRORS, TP_SAMPLE = 6_000, 3_000


def hash_order(seed: int, *keys: str) -> Column:
    """A uniform order of rows that does not depend on partitions: by hash, then by key."""
    return F.struct(prefix(F.concat_ws(":", F.lit(str(seed)), *keys)).alias("h"), *keys)


def capped(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """The n first rows by hash order. A limit over a sort keeps n rows a task, whatever the input."""
    return rows.withColumn("_o", hash_order(seed, *keys)).orderBy("_o").limit(n).drop("_o")


def mine(samples: DataFrame, det: DataFrame, gt: DataFrame, conf: float = 0.25, max_errors: int = MAX_ERRORS, tp_sample: int = TP_SAMPLE, seed: int = 0) -> DataFrame:
    """Errors (without duplicates) and sampled true positives of at least `MIN_SIDE` a side, with attributes and weight.

    Errors weigh 1. A true positive weighs the inverse of the share that was sampled; capped errors are not reweighted.
    """
    found = tide.records(samples, det, gt, conf).withColumn("own", F.coalesce("det_id", "box_id"))
    found = stored(found.filter((F.col("kind") != "dupe") & (F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= MIN_SIDE)))  # read for errors, true positives and their number
    errors = capped(found.filter("kind <> 'tp'"), max_errors, seed, "image_id", "kind", "own").withColumn("weight", F.lit(1.0))
    tps = found.filter("kind = 'tp'")
    total = tps.agg(F.count(F.lit(1)).alias("n_tp"))
    sampled = capped(tps, tp_sample, seed, "image_id", "kind", "own").crossJoin(F.broadcast(total))  # one row
    sampled = sampled.withColumn("weight", F.greatest(F.lit(1.0), F.col("n_tp") / F.lit(float(tp_sample)))).drop("n_tp")
    out = errors.unionByName(sampled).withColumn("is_error", F.col("kind") != "tp")
    return out.join(samples, "image_id")


def context_box(box: str, width: str, height: str, context: float = 0.6) -> Column:
    """The square crop around a box: side at least 24, cut to the image and to whole pixels, never empty."""
    b = F.col(box)
    side = F.greatest(F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]) * (1 + context), F.lit(24.0))
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    whole = lambda x: x.cast("int")  # toward zero
    x1, y1 = whole(F.greatest(F.lit(0.0), cx - side / 2)), whole(F.greatest(F.lit(0.0), cy - side / 2))
    x2, y2 = whole(F.least(F.col(width).cast("double"), cx + side / 2)), whole(F.least(F.col(height).cast("double"), cy + side / 2))
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.greatest(x2, x1 + 1).alias("x2"), F.greatest(y2, y1 + 1).alias("y2"))


def geometry(rows: DataFrame) -> DataFrame:
    """log_size, aspect and cy of each box (the parts of a photometric description that need no pixels), on whole pixels inside the image."""
    near = lambda c: F.bround(c).cast("int")
    x1, y1 = F.greatest(near("x1"), F.lit(0)), F.greatest(near("y1"), F.lit(0))
    x2 = F.least(F.greatest(near("x2"), x1 + 1), F.col("width"))
    y2 = F.least(F.greatest(near("y2"), y1 + 1), F.col("height"))
    w, h = F.greatest(x2 - x1, F.lit(1)), F.greatest(y2 - y1, F.lit(1))
    return rows.withColumns({"log_size": F.log(F.sqrt(w * h) / F.hypot("width", "height")), "aspect": F.log(w / h), "cy": (y1 + y2) / 2 / F.col("height")})
