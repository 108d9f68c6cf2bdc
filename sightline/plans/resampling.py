"""The paired bootstrap over the ten thresholds, on the slices that the gate aims at.

A thousand replicates are too slow in SQL; tests hold the operator against images that are really repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import average_precision as ap
from sightline.operators import bootstrap, match
from sightline.schema import SLICES, THRESHOLDS
from sightline.sources.tables import Views

TARGETS = ["night"]
REPLICATES = 1000


def deltas(v: Views, base: DataFrame, cand: DataFrame) -> DataFrame:
    """bootstrap_delta of two match tables on the target slices."""
    npos = match.counted(v.gt()).select("cls", "image_id", "n")
    images = ap.slice_membership(v.samples()).filter(F.col("slice").isin(TARGETS))
    return bootstrap.bootstrap_delta(base, cand, npos, images, THRESHOLDS, REPLICATES)


def _bootstrap(spark, sf_dir):
    v = Views(spark, sf_dir)
    targeted = " or ".join(f"({SLICES[t]})" for t in TARGETS)  # matching stays inside an image, so the images of the targets are enough
    out = deltas(v, *(match.match_masks(v.det(m, targeted), v.gt(), THRESHOLDS) for m in ("baseline", "candidate")))
    return out.select("slice", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


QUERIES = {"bootstrap_delta": _bootstrap}
SQL: dict[str, str] = {}
