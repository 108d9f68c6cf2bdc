"""Error types of detections: tp, dupe, cls, loc, both, bkg, and miss for ground truth that none took.

One row an image holds its detections and boxes. Only the taking of boxes is sequential (a fold, as in matching); every other type
follows from the best overlaps with the same class and with others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.match import assign, by_image, candidates, fixed, iou

KINDS = ["tp", "dupe", "cls", "loc", "both", "bkg", "miss"]


def records(samples: DataFrame, det: DataFrame, gt: DataFrame, conf: float = 0.25, t_fg: float = 0.5, t_bg: float = 0.1) -> DataFrame:
    """image_id, kind, det_id, box_id (of a miss, or the box that cls, loc and both cover), cls, score, iou, gt_cls (-1: none), covered_by,
    and x1, y1, x2, y2 of the record's own box: the detection's, or the missed ground truth's.

    All detections and boxes of one image are gathered to one row.
    """
    rows = by_image(det.filter(F.col("score") >= conf), gt, None, samples)
    rows = fixed(fixed(rows, cs=candidates(t_fg)), taken=assign("cs", t_fg))

    def best(d: Column, same: bool) -> Column:
        """The best overlap with boxes of the same or of other classes; ties to the smaller box_id."""
        near = F.filter("gs", lambda g: (g["cls"] == d["cls"]) if same else (g["cls"] != d["cls"]))
        return F.array_min(F.transform(near, lambda g: F.struct((-iou(d, g)).alias("niou"), g["box_id"].alias("box_id"), g["cls"].alias("cls"))))

    typed = F.transform(
        "ds",
        lambda d, i: F.struct(
            d["det_id"].alias("det_id"), d["cls"].alias("cls"), d["score"].alias("score"), F.get("taken", i).alias("hit"), best(d, True).alias("s"), best(d, False).alias("o"),
            F.get(F.filter(F.get("cs", i)["c"], lambda c: c["box_id"] == F.get("taken", i)), F.lit(0))["niou"].alias("hit_niou"),
        ),
    )
    rows = fixed(rows, near=typed)
    si, oi = "coalesce(-x.s.niou, 0D)", "coalesce(-x.o.niou, 0D)"
    kind = f"case when x.hit is not null then 'tp' when {si} >= {t_fg}D then 'dupe' when {oi} >= {t_fg}D then 'cls' when {si} >= {t_bg}D then 'loc' when {oi} >= {t_bg}D then 'both' else 'bkg' end"
    rows = fixed(rows, kinds=F.expr(f"transform(near, x -> struct(x.det_id, x.cls, x.score, x.hit, x.s, x.o, x.hit_niou, {kind} as kind))"))
    rows = fixed(
        rows,
        t=F.expr(
            f"""transform(kinds, (x, i) -> struct(x.kind, x.det_id, x.cls, x.score,
                case x.kind when 'tp' then -x.hit_niou when 'dupe' then {si} when 'cls' then {oi} when 'loc' then {si} when 'both' then {oi} else greatest({si}, {oi}) end as iou,
                case x.kind when 'tp' then x.hit when 'loc' then x.s.box_id when 'cls' then x.o.box_id when 'both' then x.o.box_id end as box_id,
                case x.kind when 'tp' then x.cls when 'loc' then x.cls when 'cls' then x.o.cls when 'both' then x.o.cls else -1 end as gt_cls,
                ds[i].x1 as x1, ds[i].y1 as y1, ds[i].x2 as x2, ds[i].y2 as y2, '' as covered_by))"""
        ),
    )
    free = F.filter("gs", lambda g: ~F.exists("taken", lambda b: b.eqNullSafe(g["box_id"])))
    cover = F.expr("transform(filter(t, x -> x.kind in ('cls', 'loc', 'both')), x -> struct(x.box_id, x.kind))")
    rows = fixed(rows, free=free, cover=cover)
    missed = F.transform(
        "free",
        lambda g: F.struct(
            F.lit("miss").alias("kind"), F.lit(None).cast("long").alias("det_id"), g["cls"].alias("cls"), F.lit(0.0).alias("score"),
            F.coalesce(F.array_max(F.transform("ds", lambda d: iou(d, g))), F.lit(0.0)).alias("iou"), g["box_id"].alias("box_id"), g["cls"].alias("gt_cls"), *[g[c].alias(c) for c in ("x1", "y1", "x2", "y2")],
            F.coalesce(F.get(F.filter("cover", lambda c: c["box_id"] == g["box_id"]), F.lit(0))["kind"], F.lit("")).alias("covered_by"),
        ),
    )
    # detections and misses leave in one list: as two tables, all before them would be done twice
    both = rows.select("image_id", F.explode(F.concat("t", missed)).alias("x"))
    return both.select("image_id", *[f"x.{c}" for c in ("kind", "det_id", "box_id", "cls", "score", "iou", "gt_cls", "covered_by", "x1", "y1", "x2", "y2")])


def summary(found: DataFrame, *groups: str) -> DataFrame:
    """Counts of each kind, n_gt, precision (duplicates are predictions), recall and uncovered misses."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    out = found.groupBy(*groups).agg(*kinds, F.count_if((F.col("kind") == "miss") & (F.col("covered_by") == "")).alias("miss_uncovered"))
    made = sum((F.col(k) for k in KINDS[1:-1]), F.col("tp"))
    real = F.col("tp") + F.col("miss")
    share = lambda n: F.when(n > 0, F.col("tp") / n).otherwise(0.0)
    return out.withColumns({"n_gt": real, "precision": F.round(share(made), 9), "recall": F.round(share(real), 9)})
