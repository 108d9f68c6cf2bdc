"""An append-only log of batches, and synthesis that resumes from it.

A batch is a folder of the log that appears once and complete, under its number; writing a number again changes nothing. So whatever stops a run, the next one
reads what was logged and goes on with the candidates that no batch holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.functions import files
from sightline.operators.synthesis import accept_until_quota
from sightline.schema import CONDITION_ATTRS


def append(df: DataFrame, path: str, batch: int) -> bool:
    """Writes a batch unless the log has one of that number; whether it was written."""
    spark, target = df.sparkSession, f"{path}/batch={batch}"
    if files.exists(spark, target):
        return False
    staged = files.staging(path)
    df.write.parquet(staged)
    return files.publish(spark, staged, target)


def batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("batch=")) for n in files.names(spark, path) if n.startswith("batch="))


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of the log; none, if it has no batch."""
    found = [f"{path}/batch={b}" for b in batches(spark, path)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def synthesize(plan: DataFrame, allocation: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, size: int, most: int | None = None) -> DataFrame:
    """The candidates tried, in order of k, until each target has its quota: what `judge` says of them (it adds accepted), from the log.

    `plan` has target and k, `allocation` target and quota. In each round every target that lacks accepted candidates has its next `size` ones judged and logged as a batch.
    Candidates logged beyond the quota do not count, so the result depends neither on `size` nor on where a run was stopped. `most` ends after so many rounds.
    """
    spark, schema, rounds = plan.sparkSession, judge(plan.limit(0)).schema, 0
    while most is None or rounds < most:
        log = read(spark, path, schema)
        have = log.groupBy("target").agg(F.count_if("accepted").alias("have"), F.max("k").alias("last"))
        open_ = allocation.select("target", "quota").join(have, "target", "left").filter(F.coalesce("have", F.lit(0)) < F.col("quota")).select("target", F.coalesce("last", F.lit(-1)).alias("last"))
        # batches hold whole stretches of k, so the next ones follow the last
        rest = plan.join(log.select("target", "k"), ["target", "k"], "left_anti").join(F.broadcast(open_), "target")  # a row a target
        ahead = rest.groupBy("target").agg(F.min("k").alias("from"))
        following = rest.join(F.broadcast(ahead), "target").filter(F.col("k") < F.col("from") + size).drop("last", "from")
        if following.isEmpty():
            break
        append(judge(following), path, max(batches(spark, path), default=-1) + 1)
        rounds += 1
    return accept_until_quota(read(spark, path, schema), allocation)


def finalize(tried: DataFrame, samples: DataFrame, source: str = "synthetic") -> DataFrame:
    """Samples of the accepted candidates (target, k, condition, image_id of the source): the source's columns with the attributes that the condition changes, and parent."""
    made = tried.filter("accepted").select("target", "k", "condition", F.col("image_id").alias("parent")).join(samples.withColumnRenamed("image_id", "parent"), "parent")
    changed = {}
    for name in ("timeofday", "weather"):
        values = {c: a[name] for c, a in CONDITION_ATTRS.items() if name in a}
        changed[name] = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("condition")), F.col(name))
    name = F.concat(F.lit(source), F.lit("_"), F.col("target").cast("string"), F.lit("_"), F.lpad(F.col("k").cast("string"), 5, "0"), F.lit("_"), F.col("parent").cast("string"))
    return made.withColumns({"image_id": name, "source": F.lit(source), **changed})


def rejections(tried: DataFrame) -> DataFrame:
    """reason and how many candidates it rejected; a candidate may have several."""
    return tried.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
