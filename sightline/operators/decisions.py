"""Drift statistics, service levels, the promotion gate, the model registry and latency figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.hashing import seeded, uniform
from sightline.functions.quantiles import quantiles

MIN_TARGET_GAIN, MAX_OVERALL_DROP, MAX_SLICE_DROP = 0.02, 0.005, 0.02


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index of one column over the reference's quantile bins; 0 with fewer than two bins."""
    shares = [k / bins for k in range(bins + 1)]
    edges = quantiles(reference, [], column, shares).select(F.array_distinct("quantiles").alias("edges"))
    rows = reference.select(F.col(column).alias("x"), F.lit(0).alias("cur")).unionByName(current.select(F.col(column).alias("x"), F.lit(1).alias("cur")))
    rows = rows.crossJoin(F.broadcast(edges))  # one row
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    rows = rows.select("cur", F.size("edges").alias("n"), F.size(F.filter(inner, lambda e: e <= F.col("x"))).alias("bin"))
    counts = rows.groupBy("n", "bin").agg(F.count_if(F.col("cur") == 0).alias("r"), F.count_if(F.col("cur") == 1).alias("c"))
    every = edges.select(F.size("edges").alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    counts = every.join(counts, ["n", "bin"], "left").fillna(0)
    whole = Window.partitionBy("n")  # at most `bins` rows
    counts = counts.select("n", (F.col("r") / F.sum("r").over(whole) + 1e-4).alias("r"), (F.col("c") / F.sum("c").over(whole) + 1e-4).alias("c"))
    return counts.agg(F.when(F.max("n") < 3, 0.0).otherwise(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r")))).alias("psi"))


def slo_violations(values: DataFrame, slos: dict[str, float]) -> DataFrame:
    """slice, map, threshold of slices below their service level; a slice without value does not count."""
    listed = F.create_map(*[F.lit(x) for kv in slos.items() for x in kv])
    return values.withColumn("threshold", listed[F.col("slice")]).filter("map < threshold").select("slice", "map", "threshold")


def gate_checks(deltas: DataFrame, base: DataFrame, cand: DataFrame, targets: list[str], require_ci: bool = True) -> DataFrame:
    """name, value, threshold, passed of each check.

    `deltas` has slice, delta, ci_low; `base` and `cand` have slice, map, gated (a row a slice).
    """
    spark = deltas.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, targets))).alias("slice")).join(deltas, "slice", "left")
    row = lambda name, value, bar, ok: F.struct(name.alias("name"), value.cast("double").alias("value"), F.lit(float(bar)).alias("threshold"), ok.alias("passed"))
    none = F.lit(None).cast("double")
    gain = F.when(F.col("delta").isNull(), row(F.concat(F.lit("target:"), "slice"), none, MIN_TARGET_GAIN, F.lit(False))).otherwise(
        row(F.concat(F.lit("target:"), "slice", F.lit(" gain")), F.col("delta"), MIN_TARGET_GAIN, F.col("delta") >= MIN_TARGET_GAIN)
    )
    sure = F.when(F.col("delta").isNotNull() & F.lit(require_ci), row(F.concat(F.lit("target:"), "slice", F.lit(" CI > 0")), F.col("ci_low"), 0.0, F.col("ci_low") > 0))
    checks = wanted.select(F.inline(F.array_compact(F.array(gain, sure))))
    overall = deltas.filter("slice = 'overall'").select(F.inline(F.array(row(F.lit("overall no-regression"), F.col("delta"), -MAX_OVERALL_DROP, F.col("delta") >= -MAX_OVERALL_DROP))))
    both = cand.filter("gated").filter(~F.col("slice").isin(*targets)).join(base.select("slice", F.col("map").alias("before")), "slice").withColumn("d", F.col("map") - F.col("before")).filter("d is not null")
    slices = both.select(F.inline(F.array(row(F.concat(F.lit("slice:"), "slice", F.lit(" no-regression")), F.col("d"), -MAX_SLICE_DROP, F.col("d") >= -MAX_SLICE_DROP))))
    return checks.unionByName(overall).unionByName(slices)


def decide(checks: DataFrame) -> DataFrame:
    """promote: all checks passed, and there is one."""
    return checks.agg(F.coalesce(F.every("passed"), F.lit(False)).alias("promote"), F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"))


def champion(history: DataFrame) -> DataFrame:
    """The latest promoted version and the highest version of an append-only history (version, event, ts)."""
    return history.agg(F.max_by(F.when(F.col("event") == "promoted", F.col("version")), F.when(F.col("event") == "promoted", F.struct("ts", "version"))).alias("champion"), F.max("version").alias("latest"))


def latency(samples: DataFrame, group: str, column: str, batch: int = 1) -> DataFrame:
    """p50, p90, p99, mean and throughput of each group."""
    means = samples.groupBy(F.struct(group).alias("g")).agg(F.avg(column).alias("mean"), (batch * 1000.0 / F.avg(column)).alias("throughput"), F.count(F.lit(1)).alias("runs"))
    found = quantiles(samples, [group], column, (0.5, 0.9, 0.99)).select(F.struct(group).alias("g"), "quantiles")
    rows = means.join(found, "g", "left")  # as structs, null groups meet too
    return rows.select(f"g.{group}", *[F.get("quantiles", F.lit(i)).alias(p) for i, p in enumerate(("p50", "p90", "p99"))], "mean", "throughput", "runs")


def trigger(reports: DataFrame) -> DataFrame:
    """Adds reasons (in this order) and whether to act. `reports` has drifted, violated and forced."""
    why = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in (("drifted", "drift"), ("violated", "slo"), ("forced", "forced"))]))
    return reports.withColumns({"reasons": why, "triggered": F.size(why) > 0})


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each name; runs have name, started and run (ties go to the larger run)."""
    newest = F.max_by(F.struct("started", "run"), F.struct("started", "run")).alias("r")
    return runs.groupBy("name").agg(newest, F.count(F.lit(1)).alias("runs")).select("name", "r.started", "r.run", "runs")


def headline(maps: DataFrame, slices: list[str]) -> DataFrame:
    """One row with the mean average precision of the named slices, each name once and in its first place."""
    names = list(dict.fromkeys(slices))
    return maps.agg(*[F.max(F.when(F.col("slice") == n, F.col("map"))).alias(n) for n in names])


def require_same_images(a: DataFrame, b: DataFrame) -> None:
    """Two models compared in pairs must have been run on the same images."""
    one, two = (x.select("image_id").distinct().withColumn(n, F.lit(True)) for x, n in ((a, "a"), (b, "b")))
    odd = one.join(two, "image_id", "full").filter(F.col("a").isNull() | F.col("b").isNull()).limit(1).collect()
    if odd:
        raise ValueError(f"image {odd[0].image_id} was evaluated by one model only")


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by hash order of a key: the same ones for any partitioning."""
    return rows.orderBy(seeded(seed, F.col(key)), key).limit(n)


def replay_sample(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """The rows whose hash of the key lies below a share: no sort, no shuffle."""
    return rows.filter(uniform(seed, F.col(key)) < share)
