"""Positions in an explicit order, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.lineage import stored


def numbered(rows: DataFrame, group: str, *order: Column | str, name: str = "pos") -> DataFrame:
    """Adds the place (from 0) of each row in its group's order. Rows go to ranges of the order; a range numbers its own on top of the ranges before."""
    if {name, "_range"} & set(rows.columns):
        raise ValueError(f"the rows have a column {name} or _range")
    ranged = stored(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))  # read for totals and again for places
    totals = ranged.groupBy(F.struct(group).alias("_g"), "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select("_g", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_g", F.struct(group)).join(before, ["_g", "_range"])
    inside = Window.partitionBy("_g", "_range").orderBy(*order)
    return placed.select(*rows.columns, (F.col("_before") + F.row_number().over(inside) - 1).alias(name))
