"""Planning and quality control of synthetic data, as joins, windows and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.hashing import uniform
from sightline.operators.match import iou
from sightline.schema import CLASSES, FALLBACK_CONDITIONS, PROMPT_END, PROMPT_RECIPES, PROMPT_SCENES, PROMPT_START, PROMPT_UNWANTED, PROMPT_UNWANTED_IN

MIN_CLIP, MIN_TARGET, MIN_BOX_PASS = 0.22, 0.6, 0.5
MIN_SIDE, IOU_SOURCE, IOU_GENERATED = 24.0, 0.5, 0.4


def allocate(targets: DataFrame, count: int) -> DataFrame:
    """Splits `count` over targets in proportion to their excess errors, by largest remainder; targets without a share go. A row a target."""
    every = Window.partitionBy(F.lit(0))
    rows = targets.withColumn("_w", F.greatest(F.coalesce("excess_errors", F.lit(1.0)), F.lit(1e-6)))
    rows = rows.withColumn("_raw", F.col("_w") / F.sum("_w").over(every) * count).withColumn("_q", F.floor("_raw"))
    left = F.lit(count) - F.sum("_q").over(every)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_raw") - F.col("_q")), "target")
    rows = rows.withColumns({"_left": left, "_r": F.row_number().over(order)})
    rows = rows.withColumn("quota", (F.col("_q") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).cast("long"))
    return rows.filter("quota > 0").drop("_w", "_raw", "_q", "_left", "_r")


def rank_sources(gt: DataFrame, targets: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """target, image_id, rank (from 0): the n images with most boxes of the target's classes, ties by a hash uniform.

    Every image is scored; the filter is on the row number itself, so that Spark limits each task to n rows a target before the shuffle.
    """
    held = gt.groupBy("image_id").agg(F.collect_list("cls").alias("cls"))
    rows = held.crossJoin(F.broadcast(targets.select("target", "classes")))  # some targets, by the allocation
    tie = uniform(seed, F.concat_ws(":", "target", "image_id"))
    score = F.size(F.filter("cls", lambda c: F.array_contains("classes", c))) + tie
    order = Window.partitionBy("target").orderBy(F.desc("score"), "image_id")
    return rows.select("target", "image_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).withColumn("rank", F.col("rank") - 1)


def plan_candidates(allocation: DataFrame, ranked: DataFrame, oversample: float = 2.0, seed: int = 1234) -> DataFrame:
    """target, k, image_id, seed: ceil(quota * oversample) candidates a target, going round the ranked sources."""
    wanted = allocation.select("target", "quota", F.explode(F.sequence(F.lit(0), F.ceil(F.col("quota") * oversample).cast("int") - 1)).alias("k"))
    sources = ranked.groupBy("target").agg(F.count(F.lit(1)).alias("n_sources"))
    wanted = wanted.join(sources, "target").withColumn("rank", (F.col("k") % F.col("n_sources")).cast("int"))
    return wanted.join(ranked, ["target", "rank"]).select("target", "k", "image_id", (F.lit(seed) + 100003 * F.col("target") + F.col("k")).cast("long").alias("seed"))


def reasons(clip: str = "clip_score", target: str = "p_target", boxes: str = "box_pass") -> Column:
    """Why a candidate is refused; an empty array accepts it."""
    return F.array_compact(F.array(F.when(F.col(clip) < MIN_CLIP, "prompt"), F.when(F.col(target) < MIN_TARGET, "condition"), F.when(F.col(boxes) < MIN_BOX_PASS, "structure")))


def box_survival(gt: DataFrame, source: DataFrame, generated: DataFrame) -> DataFrame:
    """image_id, survival, judged: the share of boxes a teacher found in the source that it still finds in the generated image; 1 if none is judged."""
    def best(found: DataFrame, name: str):
        f = found.groupBy("image_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("f"))
        return f.withColumnRenamed("f", name)

    big = gt.filter((F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= MIN_SIDE))
    rows = gt.select("image_id").distinct().join(big.select("image_id", F.struct("x1", "y1", "x2", "y2").alias("b")), "image_id", "left")
    rows = rows.join(best(source, "s"), "image_id", "left").join(best(generated, "g"), "image_id", "left")
    top = lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: iou(F.col("b"), x))), F.lit(0.0))
    judged = F.col("b").isNotNull() & (top("s") >= IOU_SOURCE)
    rows = rows.select("image_id", judged.alias("judged"), (top("g") >= IOU_GENERATED).alias("held"))
    out = rows.groupBy("image_id").agg(F.avg(F.when(F.col("judged"), F.col("held").cast("double"))).alias("survival"), F.count_if("judged").alias("judged"))
    return out.withColumn("survival", F.coalesce("survival", F.lit(1.0)))


def accept_until_quota(candidates: DataFrame, allocation: DataFrame) -> DataFrame:
    """Candidates that are tried, in order of k, until a target has its quota: those with fewer accepted before them than the quota."""
    before = Window.partitionBy("target").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = candidates.withColumn("_before", F.coalesce(F.sum(F.col("accepted").cast("int")).over(before), F.lit(0)))
    return rows.join(F.broadcast(allocation.select("target", "quota")), "target").filter(F.col("_before") < F.col("quota")).drop("_before", "quota")


def summary(tried: DataFrame) -> DataFrame:
    """candidates, accepted, acceptance_rate and conditional means."""
    mean = lambda c, ok: F.avg(F.when(F.col("accepted") == ok, F.col(c)))
    rate = F.coalesce(F.avg(F.col("accepted").cast("double")), F.lit(0.0))
    return tried.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("accepted").alias("accepted"), rate.alias("acceptance_rate"),
        mean("clip_score", True).alias("mean_clip_score"), mean("p_target", True).alias("mean_p_target"), mean("box_pass", True).alias("mean_box_pass"), mean("p_target", False).alias("mean_p_target_rejected"),
    )


def select_real(pool: DataFrame, allocation: list[dict], n: int) -> DataFrame:
    """Real images for the same budget: each target takes the first of its condition in pool order, then the rest of the pool tops up to n.

    `pool` has image_id, timeofday, weather and pos (its order). The allocation is a short list, taken in turn.
    """
    match = {"night": "timeofday = 'night'", "glare": "timeofday = 'night'", "dusk": "timeofday = 'dawn'", "rain": "weather = 'rainy'", "snow": "weather = 'snowy'", "fog": "weather = 'foggy'"}
    left, chosen = pool, None
    for a in allocation:
        part = left.filter(match.get(a["condition"], "true")).orderBy("pos").limit(a["quota"]).select("image_id", "pos", F.lit(a["condition"]).alias("why"))
        chosen = part if chosen is None else chosen.unionByName(part)
        left = pool.join(chosen.select("image_id"), "image_id", "left_anti")
    rest = left.orderBy("pos").limit(n).select("image_id", "pos", F.lit("top-up").alias("why"))
    both = chosen.withColumn("_late", F.lit(0)).unionByName(rest.withColumn("_late", F.lit(1))) if chosen is not None else rest.withColumn("_late", F.lit(0))
    return both.orderBy("_late", "pos").limit(max(n, sum(a["quota"] for a in allocation))).drop("_late", "pos")


def _looked_up(values: dict, key: str) -> Column:
    """The value of a column's key; null for others."""
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), value(v))]), F.col(key))


def prompts(rows: DataFrame, key: Column, seed: int = 1234) -> DataFrame:
    """Adds prompt and negative_prompt for each row's condition and scene; the recipe is chosen by a hash of the key. A scene without words is a city street.

    A condition without a recipe raises.
    """
    recipes = F.coalesce(_looked_up(PROMPT_RECIPES, "condition"), F.raise_error(F.concat(F.lit("no recipe for the condition "), F.coalesce("condition", F.lit("null")))))
    recipe = F.get(recipes, F.floor(uniform(seed, key) * F.size(recipes)).cast("int"))
    scene = F.coalesce(_looked_up(PROMPT_SCENES, "scene"), F.lit(PROMPT_SCENES["city_street"]))
    wanted = F.concat(F.lit(f"{PROMPT_START} "), scene, F.lit(" "), recipe, F.lit(f", {PROMPT_END}"))
    return rows.withColumns({"prompt": wanted, "negative_prompt": F.concat_ws(", ", F.lit(PROMPT_UNWANTED), _looked_up(PROMPT_UNWANTED_IN, "condition"))})


def fallback_targets(violations: DataFrame) -> DataFrame:
    """Targets from slices (a column slice) below their service level, for conditions that images can be made for: cars and pedestrians, with one excess error each."""
    rows = violations.filter(F.col("slice").isin(*FALLBACK_CONDITIONS))
    classes = F.array(*[F.lit(CLASSES.index(c)) for c in ("car", "pedestrian")])
    name = F.concat(F.lit("SLO slice "), "slice", F.lit(" (fallback)"))
    return rows.select(F.lit(None).cast("int").alias("cluster"), _looked_up(FALLBACK_CONDITIONS, "slice").alias("condition"), classes.alias("classes"), F.lit(1.0).alias("excess_errors"), name.alias("name"))


def targets_or_fallback(targets: DataFrame, violations: DataFrame) -> DataFrame:
    """The targets, or, where there is none, those of the violated slices. Both have cluster, condition, classes, excess_errors, name."""
    one = targets.limit(1).select(F.lit(True).alias("_any"))
    return targets.unionByName(fallback_targets(violations).join(F.broadcast(one), F.col("_any"), "left_anti"))
