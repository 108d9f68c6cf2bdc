"""Leakage-free splits: whole groups of images, drawn in proportion to strata, and a frozen evaluation set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import files
from sightline.functions.hashing import seeded
from sightline.functions.lineage import cut
from sightline.functions.ordering import numbered
from sightline.operators.validation import digest

STRATA = ("timeofday", "weather")


def group_key(image_id: str):
    """The part of an image's name before the first dash."""
    return F.split_part(F.col(image_id), F.lit("-"), F.lit(1))


def stratified_take(samples: DataFrame, n: int, seed: int, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """Whole groups until at least n images, evenly over strata. A group's stratum is that of its first image.

    Within a stratum groups go by hash; all groups then go by their place there, (i + 0.5) / n. Only one row a group is ranked, in bins of
    the hash, so a stratum that holds most groups is many tasks' work; the running size is taken within bins of the place, on top of the bins before.
    """
    if n <= 0:
        return samples.limit(0)
    cells = [F.coalesce(F.col(c), F.lit("?")).alias(c) for c in strata]
    groups = samples.groupBy("group_id").agg(F.min_by(F.struct(*cells), "image_id").alias("cell"), F.count(F.lit(1)).alias("size"))
    # places in a stratum: within bins of the hash, on top of the groups in the bins before
    groups = groups.withColumn("hash", seeded(seed, F.col("group_id"))).withColumn("slot", F.substring("hash", 1, 2))
    whole = Window.partitionBy("cell")  # 256 rows a stratum
    earlier = whole.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = groups.groupBy("cell", "slot").agg(F.count(F.lit(1)).alias("held"))
    slots = slots.select("cell", "slot", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("above"), F.sum("held").over(whole).alias("count"))
    order = Window.partitionBy("cell", "slot").orderBy("hash", "group_id")
    groups = groups.join(F.broadcast(slots), ["cell", "slot"]).withColumn("place", (F.col("above") + F.row_number().over(order) - 0.5) / F.col("count"))
    groups = groups.drop("hash", "slot", "above", "count").withColumn("bin", F.floor(F.col("place") * 256).cast("int"))
    groups = groups.withColumn("tie", seeded(seed + 1, F.col("group_id")))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    bins = groups.groupBy("bin").agg(F.sum("size").alias("in_bin")).select("bin", F.coalesce(F.sum("in_bin").over(before), F.lit(0)).alias("in_bins"))
    inside = Window.partitionBy("bin").orderBy("place", "tie", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.join(F.broadcast(bins), "bin").withColumn("taken", F.col("in_bins") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return samples.join(groups.filter(F.col("taken") < n).select("group_id"), "group_id", "left_semi")


def make_splits(samples: DataFrame, sizes: dict[str, dict[str, int]], seed: int = 2026, locked: DataFrame | None = None) -> DataFrame:
    """image_id, split: golden, probe, val_day, train_day, target_pool.

    Each split takes whole groups out of what the ones before left; an image whose group went to another split stays out. A locked golden
    set (image_id) is taken as it is; a locked image that is missing is an error.
    """
    usable = samples.filter(F.col("timeofday").isin("day", "night", "dawn"))
    of = lambda rows, tod: rows.filter(F.col("timeofday") == tod)

    def take(rows, want, s):
        out = None
        for tod in ("day", "night", "dawn"):
            part = stratified_take(of(rows, tod), want.get(tod, 0), s)
            out = part if out is None else out.unionByName(part)
        return out

    def without(rows, taken):
        return rows.join(taken.select("group_id").distinct(), "group_id", "left_anti")

    if locked is not None:
        missing = locked.join(samples, "image_id", "left_anti").limit(1).count()
        if missing:
            raise ValueError("images of the locked golden set are missing from the data")
        golden = samples.join(locked.select("image_id"), "image_id", "left_semi")
    else:
        golden = take(usable, sizes["golden"], seed)
    # a split is a table of its own before the next one looks at what is left
    golden = cut(golden.select(*samples.columns))
    left = without(usable, golden)
    probe = cut(take(left, sizes["probe"], seed + 10))
    left = without(left, probe)
    val = cut(stratified_take(of(left, "day"), sizes["val_day"]["day"], seed + 20))
    left = cut(without(left, val))
    n_train = sizes.get("train_day", {}).get("day", 0)
    train = stratified_take(of(left, "day"), n_train, seed + 30) if n_train > 0 else of(left, "day")
    train = cut(train)
    left = without(left, train)
    pool = left.filter(F.col("timeofday").isin("night", "dawn"))
    named = [golden, probe, val, train, pool]
    out = None
    for name, rows in zip(("golden", "probe", "val_day", "train_day", "target_pool"), named, strict=True):
        rows = rows.select("image_id", F.lit(name).alias("split"))
        out = rows if out is None else out.unionByName(rows)
    return out


def canonical(splits: DataFrame, seed: int = 2026) -> DataFrame:
    """Adds pos, an image's place in its split: the golden set by image, so that paired comparisons line up, and the others by hash."""
    key = F.when(F.col("split") == "golden", F.lit("")).otherwise(seeded(seed + 40, F.col("image_id")))
    return numbered(splits, "split", key, "image_id")


def check_disjoint(splits: DataFrame, samples: DataFrame) -> DataFrame:
    """Groups that lie in more than one split, with those splits."""
    rows = splits.join(samples.select("image_id", "group_id"), "image_id")
    return rows.groupBy("group_id").agg(F.sort_array(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def describe(splits: DataFrame, samples: DataFrame, gt: DataFrame) -> DataFrame:
    """split, images, boxes, and images by time of day and by weather (missing: ?)."""
    boxes = gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("boxes"))
    rows = splits.join(samples, "image_id").join(boxes, "image_id", "left")
    total = rows.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum(F.coalesce("boxes", F.lit(0))).alias("boxes"))
    for c in STRATA:
        counts = rows.groupBy("split", F.coalesce(F.col(c), F.lit("?")).alias("k")).agg(F.count(F.lit(1)).alias("v"))
        held = counts.groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(f"by_{c}"))
        total = total.join(held, "split")
    return total


def write_lock(golden: DataFrame, samples: DataFrame, gt: DataFrame, path: str) -> str:
    """Locks a golden set (image_id): its images, with a digest of their labels that `read_lock` holds the data against. A lock is written once."""
    spark = golden.sparkSession
    ids = golden.select("image_id").distinct()
    value = _digest(ids, samples, gt)
    staged = files.staging(path)
    ids.withColumn("digest", F.lit(value)).write.parquet(staged)
    if not files.publish(spark, staged, f"{path}/lock"):
        raise ValueError(f"{path} holds a lock already")
    return value


def read_lock(samples: DataFrame, gt: DataFrame, path: str) -> DataFrame:
    """The images of a lock, for `make_splits`. Locked images that are missing, and labels that are not those that were locked, raise."""
    lock = samples.sparkSession.read.parquet(f"{path}/lock")
    ids = lock.select("image_id")
    if not ids.join(samples, "image_id", "left_anti").isEmpty():
        raise ValueError("images of the locked golden set are missing from the data")
    told = [r.digest for r in lock.select("digest").distinct().collect()]  # one value
    if told != [_digest(ids, samples, gt)]:
        raise ValueError("labels of the locked golden set have changed")
    return ids


def _digest(ids: DataFrame, samples: DataFrame, gt: DataFrame) -> str:
    mine = lambda t: t.join(ids, "image_id", "left_semi")
    return digest(mine(samples), mine(gt)).first().digest
