"""Box matching inside an image: overlap pairs, and greedy one-to-one assignment.

Both inputs shuffle once, by image (at most `max_det` detections each). Most pairs that overlap enough stand alone, and are judged by plain
comparisons; detections that share a box, or have several, are walked in order of their scores, those of many images at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.schema import AREAS, MAX_DETECTIONS, THRESHOLDS


def area(b: Column | str) -> Column:
    b = F.col(b) if isinstance(b, str) else b
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 for an empty union."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = width * height
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - both
    return F.when(union <= 0, 0.0).otherwise(both / F.greatest(union, F.lit(1e-12)))


def iou_pairs(det: DataFrame, gt: DataFrame) -> DataFrame:
    """All overlapping pairs of an image: image_id, det_id, box_id, same_class, iou."""
    box = lambda *names: F.struct(*[F.col(n) for n in names])
    d = det.select("image_id", "det_id", F.col("cls").alias("det_cls"), box("x1", "y1", "x2", "y2").alias("d"))
    g = gt.select("image_id", "box_id", F.col("cls").alias("gt_cls"), box("x1", "y1", "x2", "y2").alias("g"))
    pairs = d.join(g, "image_id").withColumn("iou", iou(F.col("d"), F.col("g"))).filter("iou > 0")
    return pairs.select("image_id", "det_id", "box_id", (F.col("det_cls") == F.col("gt_cls")).alias("same_class"), "iou")


def top_detections(det: DataFrame, n: int = MAX_DETECTIONS) -> DataFrame:
    """The n best detections of each image, over all classes; equal scores in det_id order."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    return det.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: a generator of one row keeps them from being inlined into each use."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def by_image(det: DataFrame, gt: DataFrame, max_det: int | None = MAX_DETECTIONS, images: DataFrame | None = None) -> DataFrame:
    """image_id, ds (detections, best first) and gs (ground truth by box_id); images with only one of them are kept.

    With `max_det`, an image's other detections are left out before its rows are gathered to an array.
    """
    if max_det:
        det = top_detections(det, max_det)
    ds = det.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("ns"), "det_id", "cls", "score", "x1", "y1", "x2", "y2"))).alias("ds"))
    gs = gt.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_id", "cls", "x1", "y1", "x2", "y2"))).alias("gs"))
    if images is None:
        out = ds.join(gs, "image_id", "full")
    else:  # images stay where their detections lie; after a full join Spark would deal all arrays anew, to few tasks, as they compress well
        out = images.select("image_id").join(ds.hint("merge"), "image_id", "left").join(gs.hint("merge"), "image_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("image_id", empty("ds"), empty("gs"))


def candidates(floor: float, same_class: bool = True) -> Column:
    """For each detection, the boxes it may match: structs of (niou, box_id, area), best first."""
    def of(d):
        near = F.filter("gs", lambda g: g["cls"] == d["cls"]) if same_class else F.col("gs")
        found = F.transform(near, lambda g: F.struct((-iou(d, g)).alias("niou"), g["box_id"].alias("box_id"), area(g).alias("area")))
        return F.struct(d["det_id"].alias("det_id"), d["cls"].alias("cls"), d["score"].alias("score"), area(d).alias("area"), F.sort_array(F.filter(found, lambda x: -x["niou"] >= floor)).alias("c"))

    return F.transform("ds", of)


def assign(cs: str, threshold: float, low: float = 0.0, high: float = 1e10) -> Column:
    """The box that each detection takes, in order: the best free one, counted boxes before ignored ones (area out of range)."""
    t = min(threshold, 1 - 1e-10)
    inside = f"x.area >= {low!r}D and x.area <= {high!r}D"
    pick = f"filter(d.c, x -> -x.niou >= {t!r}D and not exists(acc, a -> a <=> x.box_id))"
    if (low, high) != AREAS["all"]:
        pick = f"concat(filter({pick}, x -> {inside}), filter({pick}, x -> not ({inside})))"
    return F.expr(f"aggregate({cs}, cast(array() as array<bigint>), (acc, d) -> array_append(acc, get({pick}, 0).box_id))")


def _outcomes(rows: pa.Table, thresholds: Sequence[float], areas: Sequence[str], keep: Sequence[str]) -> pa.Table:
    """Masks of the detections of whole images. Rows are a detection and a box it overlaps enough, or none, by image, rank of the detection, overlap and box."""
    value = lambda c: rows[c].to_numpy(zero_copy_only=False)
    image, rank = np.cumsum(value("_row") == 1), value("rank")
    starts = np.flatnonzero((np.diff(image, prepend=0) > 0) | (np.diff(rank, prepend=0) != 0))
    det = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rank))))
    of = np.flatnonzero(rows["box_id"].is_valid().to_numpy(zero_copy_only=False))
    boxes, mine, overlap, size = pc.fill_null(rows["box_id"], 0).to_numpy()[of], det[of], value("iou")[of], value("garea")[of]
    order = np.lexsort((boxes, pc.fill_null(rows["cls"], 0).to_numpy()[of], image[of]))
    keys = [k[of][order] for k in (image, pc.fill_null(rows["cls"], 0).to_numpy())] + [boxes[order]]
    box = np.empty(len(of), np.int64)
    box[order] = np.cumsum(np.any([np.diff(k, prepend=k[:1]) != 0 for k in keys], axis=0))
    enough = ~(overlap < np.array([min(t, 1 - 1e-10) for t in thresholds])[:, None])
    alone = (np.bincount(mine, minlength=len(starts))[mine] == 1) & (np.bincount(box, minlength=1)[box] == 1)
    # the others are taken in turns: each turn has the next such detection of every image, as images do not meet
    rest = np.flatnonzero(~alone)
    first = np.flatnonzero(np.diff(mine[rest], prepend=-1) > 0)
    held = image[of][rest][first]
    turn = np.arange(len(first)) - np.searchsorted(held, held)
    turns = np.repeat(turn, np.diff(np.append(first, len(rest))))
    rest = rest[np.argsort(turns, kind="stable")]
    cuts = np.append(0, np.cumsum(np.bincount(turns))) if len(rest) else [0]
    own, bits, out = value("area")[starts], 1 << np.arange(len(thresholds)), []
    for name in areas:
        low, high = AREAS[name]
        inside = np.ones(len(of), bool) if name == "all" else (size >= low) & (size <= high)
        hit, counts = np.zeros((2, len(thresholds), len(starts)), bool)
        hit[:, mine[alone]], counts[:, mine[alone]] = enough[:, alone], enough[:, alone] & inside[alone]
        taken = np.zeros((len(thresholds), box.max(initial=0) + 1), bool)
        for begin, end in zip(cuts[:-1], cuts[1:]):
            r = rest[begin:end]
            at = np.flatnonzero(np.diff(mine[r], prepend=-1))
            free = enough[:, r] & ~taken[:, box[r]]
            best = lambda which: np.minimum.reduceat(np.where(which, np.arange(len(r)), len(r)), at, axis=1)  # noqa: B023, E731
            counted = best(free & inside[r])
            pick = np.where(counted < len(r), counted, best(free))
            k, d = np.nonzero(pick < len(r))
            chosen = r[pick[k, d]]
            taken[k, box[chosen]], hit[k, mine[chosen]], counts[k, mine[chosen]] = True, True, inside[chosen]
        outside = np.zeros(len(starts), bool) if name == "all" else ~((own >= low) & (own <= high))
        out.append(pa.StructArray.from_arrays([pa.array(bits @ counts), pa.array(bits @ np.where(hit, ~counts, outside))], ["tp", "ign"]))
    kept = rows.select(["image_id", "det_id", "cls", "score", *keep]).take(pa.array(starts))
    return pa.Table.from_arrays([*kept.columns, *out], names=[*kept.column_names, *areas])


def match_masks(
    det: DataFrame, gt: DataFrame, thresholds: list[float] | None = None, areas: list[str] | None = None, max_det: int = MAX_DETECTIONS, images: DataFrame | None = None
) -> DataFrame:
    """Per detection: image_id, det_id, cls, score, further columns of `images`, and for each area name a struct of masks (tp, ign), whose k-th bit stands for the k-th threshold.

    Detections are joined to the boxes of their class that they overlap enough. A detection and a box that have only each other stand for themselves, by
    comparisons over whole batches; the others are taken in the order of their scores, one of every image at a time. With `images` (a row an image), detections
    of others are left out.
    """
    thresholds, areas, keep = thresholds or THRESHOLDS, areas or ["all"], [c for c in images.columns if c != "image_id"] if images is not None else []
    corners = ("x1", "y1", "x2", "y2")
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    d = det.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_det).select("image_id", "det_id", "cls", "score", "rank", *corners)
    if images is not None:  # joined where the order by image serves this join and the next
        d = d.join(images.hint("merge"), "image_id")
    g = gt.filter("box_id is not null").select(F.col("image_id").alias("_image"), "box_id", F.col("cls").alias("_cls"), *[F.col(c).alias(f"g{c}") for c in corners])
    mine, box = F.struct(*corners), F.struct(*[F.col(f"g{c}").alias(c) for c in corners])
    # the class is no key of the join: images keep their places, and Spark would deal them anew by both
    near = (F.col("image_id") == F.col("_image")) & (F.col("cls") - F.col("_cls") == 0) & (iou(mine, box) >= min(thresholds))
    pairs = d.join(g.hint("merge"), near, "left").select("image_id", "det_id", "cls", "score", "rank", area(mine).alias("area"), "box_id", iou(mine, box).alias("iou"), area(box).alias("garea"), *keep)
    # the window keeps an image in one task, and puts its rows in the order of the walk
    pairs = pairs.withColumn("_row", F.row_number().over(Window.partitionBy("image_id").orderBy("rank", -F.col("iou"), "box_id")))
    held = T.StructType([T.StructField("tp", T.LongType()), T.StructField("ign", T.LongType())])
    schema = T.StructType([pairs.schema[c] for c in ("image_id", "det_id", "cls", "score", *keep)] + [T.StructField(a, held) for a in areas])

    def run(batches):
        left = []
        for batch in batches:
            new = np.flatnonzero(batch["_row"].to_numpy() == 1)
            if not len(new):  # an image that began before and goes on
                left.append(batch)
                continue
            left.append(batch.slice(0, new[-1]))
            ready = pa.Table.from_batches(left)
            if ready.num_rows:
                yield from _outcomes(ready, thresholds, areas, keep).to_batches()
            left = [batch.slice(new[-1])]
        if left:
            yield from _outcomes(pa.Table.from_batches(left), thresholds, areas, keep).to_batches()

    return pairs.mapInArrow(run, schema)


def greedy_match(det: DataFrame, gt: DataFrame, thresholds: list[float] | None = None, areas: list[str] | None = None, max_det: int = MAX_DETECTIONS) -> DataFrame:
    """Per detection: image_id, det_id, cls, score, and for each area name an array over thresholds of structs (tp, ign)."""
    thresholds, areas = thresholds or THRESHOLDS, areas or ["all"]
    bit = lambda name, c, k: F.col(name)[c].bitwiseAND(F.lit(1 << k)) != 0
    each = lambda name: F.array(*[F.struct(bit(name, "tp", k).alias("tp"), bit(name, "ign", k).alias("ign")) for k in range(len(thresholds))])
    return match_masks(det, gt, thresholds, areas, max_det).select("image_id", "det_id", "cls", "score", *[each(name).alias(name) for name in areas])


def masks(matched: DataFrame, name: str, n: int) -> tuple[Column, Column]:
    """Masks of the true and of the false positives over n thresholds, of a column of match_masks or of greedy_match."""
    outcome = F.col(name)
    if isinstance(matched.schema[name].dataType, T.StructType):
        return outcome["tp"], F.bitwise_not(outcome["tp"].bitwiseOR(outcome["ign"])).bitwiseAND(F.lit((1 << n) - 1))
    mask = lambda test: sum((F.when(test(outcome[k]), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(n)), F.lit(0)).cast("long")
    return mask(lambda o: o["tp"]), mask(lambda o: ~o["tp"] & ~o["ign"])


def counted(gt: DataFrame, areas: list[str] | None = None) -> DataFrame:
    """area, cls, image_id, n (1): a row for each box and area that counts it."""
    ranges = F.array(*[F.struct(F.lit(n).alias("area"), F.lit(AREAS[n][0]).alias("lo"), F.lit(AREAS[n][1]).alias("hi")) for n in (areas or ["all"])])
    rows = gt.withColumns({"size": area(F.struct("x1", "y1", "x2", "y2")), "r": F.explode(ranges)})
    return rows.filter("size between r.lo and r.hi").select(F.col("r.area").alias("area"), "cls", "image_id", F.lit(1).cast("long").alias("n"))


def positives(gt: DataFrame, areas: list[str] | None = None) -> DataFrame:
    """Counted ground truth per area, class and image."""
    return counted(gt, areas).groupBy("area", "cls", "image_id").agg(F.count(F.lit(1)).alias("n"))
