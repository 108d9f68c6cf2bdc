"""A model registry on a shared file system: numbered versions, an append-only history, and the champion folded from it.

An event is a file that appears once and complete. A version's event is named by its number, so of two writers that want the same number one takes the next; weights
are copied under a name of their own before, and no reader sees a version without them.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import files

HISTORY = "event string, version int, weights string, run_id string, arm string, parent int, golden map<string,double>, note string, reason string, time timestamp"


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _event(spark: SparkSession, root: str, name: str, event: dict) -> bool:
    staged = files.staging(f"{root}/history")
    files.write_text(spark, staged, json.dumps(event))
    return files.publish(spark, staged, f"{root}/history/{name}.json")


def register(spark: SparkSession, root: str, weights: str, *, run_id: str, arm: str, golden: dict[str, float | None], parent: int | None = None, promote: bool = False, note: str = "") -> int:
    """Copies the weights and writes the version's event; returns the version. Unmeasured scores are None."""
    kept = f"{root}/models/{uuid.uuid4().hex}"
    files.copy(spark, weights, kept)
    while True:
        taken = [int(n[1:-5]) for n in files.names(spark, f"{root}/history") if n[0] == "v"]
        version = max(taken, default=0) + 1
        event = {"event": "promoted" if promote else "registered", "version": version, "weights": kept, "run_id": run_id, "arm": arm, "parent": parent, "golden": golden, "note": note, "time": _now()}
        if _event(spark, root, f"v{version}", event):
            return version


def reject(spark: SparkSession, root: str, *, run_id: str, arm: str, reason: str) -> None:
    _event(spark, root, f"r{uuid.uuid4().hex}", {"event": "rejected", "run_id": run_id, "arm": arm, "reason": reason, "time": _now()})


def history(spark: SparkSession, root: str) -> DataFrame:
    """All events; none, if nothing was written."""
    if not files.names(spark, f"{root}/history"):
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).json(f"{root}/history")


def champion(spark: SparkSession, root: str) -> DataFrame:
    """The version promoted last, as its event's row; no row, if there is none or its weights are gone."""
    promoted = history(spark, root).filter("event = 'promoted'")
    row = promoted.agg(F.max_by(F.struct(*promoted.columns), F.col("version")).alias("r")).filter("r is not null").select("r.*")
    found = row.select("weights").collect()  # one row
    return row if found and files.exists(spark, found[0].weights) else row.limit(0)
