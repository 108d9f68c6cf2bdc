"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and label (the smallest node of its component) for all nodes of links (a, b).

    Every round takes the smallest label among the neighbours and then the label of that label, so
    paths shorten by half or better. Rounds are written tables, and end when no label changed.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.save(both, f"{name}_links")
    now = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{name}_0")
    number = 0
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = now.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        number += 1
        after = scratch.save(nearer.join(jump, "label", "left").select("node", "before", F.coalesce(F.least("label", "jump"), "label").alias("label")), f"{name}_{number}")
        scratch.drop(f"{name}_{number - 1}")
        changed = after.filter("label <> before").limit(1).count()
        now = after.select("node", "label")
        if not changed:
            scratch.drop(f"{name}_links")
            return now
