"""Failure modes: statistics of clusters of records, concept enrichment, ranking and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.schema import CONDITIONS

MIN_LIFT, TOP_MODES, ENRICHED = 1.2, 3, 1.05


def standardize(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / (population deviation + 1e-6) for each column; the statistics are one row."""
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6) for c in columns}).drop(*[f"_{x}_{c}" for c in columns for x in "ms"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def zero_shot(items: DataFrame, concepts: DataFrame, scale: float = 30.0, key: str = "vec_id") -> DataFrame:
    """key, concept, p: the softmax over concepts of the scaled cosine. Both inputs have unit vectors `embedding`; concepts are a short list."""
    held = concepts.agg(F.sort_array(F.collect_list(F.struct("concept", "embedding"))).alias("cs"))
    rows = items.select(key, "embedding").crossJoin(F.broadcast(held))  # one row
    rows = rows.select(key, F.inline(F.array(F.struct(F.transform("cs", lambda c: F.struct(c["concept"].alias("concept"), (scale * dot(F.col("embedding"), c["embedding"])).alias("z"))).alias("zs")))))
    rows = rows.select(key, "zs", F.inline(F.array(F.struct(F.array_max(F.transform("zs", lambda x: x["z"])).alias("top")))))
    total = F.aggregate("zs", F.lit(0.0), lambda s, x: s + F.exp(x["z"] - F.col("top")))
    rows = rows.withColumn("total", total).select(key, "top", "total", F.explode("zs").alias("z"))
    return rows.select(key, F.col("z.concept").alias("concept"), (F.exp(F.col("z.z") - F.col("top")) / F.col("total")).alias("p"))


def cluster_stats(items: DataFrame) -> DataFrame:
    """cluster, size, errors, error_rate, lift, excess_errors. Items have cluster (-1: noise), is_error, weight."""
    error = F.col("is_error").cast("double")
    total = items.agg((F.sum(error) / F.sum("weight")).alias("overall"))
    held = items.filter("cluster <> -1").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(error).alias("errors"), F.sum("weight").alias("w"))
    held = held.crossJoin(F.broadcast(total))  # one row
    rate = F.coalesce(F.try_divide("errors", "w"), F.lit(0.0))
    held = held.withColumn("error_rate", rate)
    lift = F.when(F.col("overall") > 0, F.col("error_rate") / F.col("overall")).otherwise(0.0)
    return held.select("cluster", "size", F.col("errors").cast("long").alias("errors"), "error_rate", lift.alias("lift"), (F.col("errors") - F.col("overall") * F.col("w")).alias("excess_errors"))


def enrichment(items: DataFrame, scores: DataFrame, key: str = "vec_id") -> DataFrame:
    """cluster, concept, enrichment: the mean probability in the cluster over that of all items."""
    rows = items.select(key, "cluster").join(scores, key)
    base = rows.groupBy("concept").agg((F.avg("p") + 1e-9).alias("base"))
    own = rows.filter("cluster <> -1").groupBy("cluster", "concept").agg(F.avg("p").alias("own"))
    return own.join(F.broadcast(base), "concept").select("cluster", "concept", (F.col("own") / F.col("base")).alias("enrichment"))


def top_concepts(enriched: DataFrame, n: int, name: str) -> DataFrame:
    """cluster and its n most enriched concepts, of which those above the bar stay (the cut comes first)."""
    order = Window.partitionBy("cluster").orderBy(F.desc("enrichment"), "concept")
    ranked = enriched.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)
    held = ranked.groupBy("cluster").agg(F.sort_array(F.collect_list(F.when(F.col("enrichment") > ENRICHED, F.struct("r", "concept")))).alias("c"))
    return held.select("cluster", F.transform("c", lambda x: x["concept"]).alias(name))


def failure_modes(stats: DataFrame, scene: DataFrame, objects: DataFrame, min_lift: float = MIN_LIFT) -> DataFrame:
    """Clusters with a name, a synthesis condition, and a rank among failure modes (lift and excess above the bars); others have no rank."""
    rows = stats.join(scene, "cluster", "left").join(objects, "cluster", "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(F.col(c), empty) for c in ("top_scene", "top_object")})
    bits = F.concat(F.slice("top_scene", 1, 2), F.slice("top_object", 1, 1))
    target = F.get(F.filter("top_scene", lambda s: s.isin(*CONDITIONS)), F.lit(0))
    mode = (F.col("lift") >= min_lift) & (F.col("excess_errors") > 0)
    order = Window.partitionBy("is_mode").orderBy(F.desc("excess_errors"), "cluster")  # a row a cluster
    rows = rows.withColumns({"name": F.when(F.size(bits) > 0, F.array_join(bits, " / ")).otherwise("generic"), "condition": target, "is_mode": mode})
    return rows.withColumn("rank", F.when(F.col("is_mode"), F.row_number().over(order)))


def targets(modes: DataFrame, classes: DataFrame, top: int = TOP_MODES) -> DataFrame:
    """The first addressable modes with their condition and up to four most common classes. `classes` has cluster and cls, a row a record."""
    chosen = modes.filter("is_mode and condition is not null").orderBy("rank").limit(top)
    counts = classes.join(chosen.select("cluster"), "cluster", "left_semi").groupBy("cluster", "cls").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "cls")
    four = counts.withColumn("r", F.row_number().over(order)).filter("r <= 4").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", "cls"))).alias("c"))
    return chosen.join(four, "cluster", "left").select("cluster", "condition", F.transform("c", lambda x: x["cls"]).alias("classes"), "excess_errors", "name", "rank")


def cluster_counts(items: DataFrame, *columns: str, top: int | None = None) -> DataFrame:
    """cluster, column, value, n and rank (most frequent first, ties by value) of the errors of each cluster; with `top`, the first ranks only."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("?")).alias("value")) for c in columns]))
    rows = items.filter(F.col("is_error") & (F.col("cluster") != -1)).select("cluster", pairs.alias("p"))
    counts = rows.groupBy("cluster", "p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("cluster", "column").orderBy(F.desc("n"), "value")  # a row a value
    counts = counts.withColumn("rank", F.row_number().over(order))
    return counts.filter(F.col("rank") <= top) if top else counts


def examples(items: DataFrame, key: str, n: int = 12) -> DataFrame:
    """The first n errors of each cluster by key; a task keeps n rows a cluster before they meet."""
    order = Window.partitionBy("cluster").orderBy(key)
    rows = items.filter(F.col("is_error") & (F.col("cluster") != -1)).select("cluster", key)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mean_features(items: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of standardized columns in each cluster."""
    return items.filter(F.col("cluster") != -1).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns])
