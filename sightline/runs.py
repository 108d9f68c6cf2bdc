"""A run over stored tables, stage by stage: evaluate, mine, intervals, gate. What a stage has written is read by the next, and a run that was stopped goes on.

A result is an artifact that appears once and complete, so a stage whose results exist is done; the settings are the first artifact, and a run does not go on with others.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.config import settings
from sightline.functions import files
from sightline.functions.lineage import stored
from sightline.operators import average_precision, bootstrap, match, mining, report
from sightline.schema import THRESHOLDS
from sightline.sources import artifacts, publishing

MODELS = ("baseline", "candidate")
#: What of a run may be published; the mined rows stay.
PUBLISHED = ["settings/", "eval/", "intervals/", "gate/", "mine/summary/"]


class Tables:
    """samples, gt and the detections of the two models."""

    def __init__(self, samples: DataFrame, gt: DataFrame, baseline: DataFrame, candidate: DataFrame):
        self.samples, self.gt, self.det = samples, gt, {"baseline": baseline, "candidate": candidate}


def _once(path: str, make: Callable[[], DataFrame], spark: SparkSession) -> bool:
    if files.exists(spark, path):
        return False
    artifacts.write_artifact(make(), path)
    return True


def _evaluate(t: Tables, folder: str, s: dict, spark: SparkSession) -> list[bool]:
    return [_once(f"{folder}/eval/{m}", lambda m=m: report.document(t.samples, t.det[m], t.gt, s["evaluation.confidence"]), spark) for m in MODELS]


def _mine(t: Tables, folder: str, s: dict, spark: SparkSession) -> list[bool]:
    mined = lambda: mining.mine(t.samples, t.det["baseline"], t.gt, s["evaluation.confidence"], s["mining.max_errors"], s["mining.tp_sample"], s["mining.seed"])
    counts = lambda: artifacts.read_artifact(spark, f"{folder}/mine/rows").groupBy("kind", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return [_once(f"{folder}/mine/rows", mined, spark), _once(f"{folder}/mine/summary", counts, spark)]


def _intervals(t: Tables, folder: str, s: dict, spark: SparkSession) -> list[bool]:
    def make() -> DataFrame:
        npos = match.positives(t.gt).select("cls", "image_id", "n")
        images = average_precision.slice_membership(t.samples).filter(F.col("slice").isin(*s["gate.targets"], "overall"))
        found = [stored(match.match_masks(t.det[m], t.gt, THRESHOLDS)) for m in MODELS]
        return bootstrap.bootstrap_delta(*found, npos, images, THRESHOLDS, s["gate.replicates"], s["gate.seed"], s["gate.level"])

    return [_once(f"{folder}/intervals", make, spark)]


def _gate(t: Tables, folder: str, s: dict, spark: SparkSession) -> list[bool]:
    if files.exists(spark, f"{folder}/gate/checks"):
        return [False]
    for name in artifacts.GATE:  # what a stopped gate left
        where, system = files._system(spark, f"{folder}/gate/{name}")
        system.delete(where, True)
    maps = [artifacts.read_artifact(spark, f"{folder}/eval/{m}").select("slice", "map", "gated") for m in MODELS]
    deltas = artifacts.read_artifact(spark, f"{folder}/intervals").select("slice", "delta", "ci_low")
    artifacts.write_gate(deltas, *maps, s["gate.targets"], f"{folder}/gate")
    return [True]


STAGES = {"evaluate": _evaluate, "mine": _mine, "intervals": _intervals, "gate": _gate}


def run(tables: Tables, folder: str, given: dict[str, Any] | None = None, until: str | None = None) -> list[str]:
    """Runs the stages that have not been done (up to `until`) and returns their names."""
    spark, held = tables.samples.sparkSession, settings(given)
    rows = spark.createDataFrame([(name, json.dumps(value)) for name, value in sorted(held.items())], "name string, value string")
    if not _once(f"{folder}/settings", lambda: rows, spark):
        before = {r.name: json.loads(r.value) for r in artifacts.read_artifact(spark, f"{folder}/settings", rows.schema).collect()}
        changed = sorted(n for n in {*before, *held} if before.get(n) != held.get(n))
        if changed:
            raise ValueError(f"{folder} was begun with other settings: {', '.join(changed)}")
    done = []
    for name, stage in STAGES.items():
        if any(stage(tables, folder, held, spark)):
            done.append(name)
        if name == until:
            break
    return done


def publish(spark: SparkSession, folder: str, target: str, roots: dict[str, str], replace: bool = False) -> list[str]:
    """Publishes a run's results without its mined rows; see `publishing.publish`."""
    return publishing.publish(spark, folder, target, roots, PUBLISHED, replace)
