"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sightline.plans import queries
from sightline.session import session

HEADLINE = ["map_by_slice", "map_by_size", "tide_by_slice", "mined", "make_splits", "iou_pairs", "greedy_match", "box_survival", "rank_sources", "enrichment", "failure_modes", "gate_decision"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found, took = queries(), {}
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
