"""Exact quantiles of groups, without a group or its distinct values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.lineage import stored


def quantiles(rows: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """The keys and `quantiles`: one number for each share, between the two nearest values in proportion (0: the least, 1: the largest).

    Equal values are counted before they move. Values then go to ranges of the order by keys and value, so a group of any size lies in many of them; totals of
    the ranges tell which hold a wanted place, and only those are ranked. Null values take no part, and a group of nulls has no row; a null key is a
    group of its own.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    counts = rows.filter(F.col(column).isNotNull()).groupBy(group.alias("g"), F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange("g", "x").withColumn("range", F.spark_partition_id()))  # read for totals and again for ranks
    whole = Window.partitionBy("g")  # a row a range
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("g", "range").agg(F.sum("n").alias("held"))
    totals = totals.withColumns({"before": F.coalesce(F.sum("held").over(before), F.lit(0)), "total": F.sum("held").over(whole)})
    at = [F.lit(float(share)) * (F.col("total") - 1) for share in shares]
    places = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("at"), near(x).alias("place")) for i, x in enumerate(at) for near in (F.floor, F.ceil)])
    first = F.col("before")
    wanted = totals.select("g", "range", "before", F.filter(places, lambda p: (p["place"] >= first) & (p["place"] < first + F.col("held"))).alias("places"))
    wanted = wanted.filter(F.size("places") > 0)
    inside = Window.partitionBy("g", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    found = ranged.join(wanted, ["g", "range"]).select("g", "x", "n", "places", start.alias("start"))
    found = found.select("g", "x", F.explode(F.filter("places", lambda p: (p["place"] >= F.col("start")) & (p["place"] < F.col("start") + F.col("n")))).alias("p"))
    ends = found.groupBy("g", "p.i", "p.at").agg(F.min_by("x", "p.place").alias("lo"), F.max_by("x", "p.place").alias("hi"))
    part = F.col("at") - F.floor("at")
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (1 - part) + F.col("hi") * part)
    held = ends.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))).alias("s"))  # a row a share
    return held.select(*[F.col(f"g.{k}").alias(k) for k in keys], F.transform("s", lambda s: s["v"]).alias("quantiles"))
