"""Domain views over the test tables: samples, ground truth and detections of three models."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.partitions import tasks

#: Kept tenths by time of day, x jitter and score multiplier of each model.
MODELS = {"baseline": ((9, 6, 7), (13, 6), 7919), "candidate": ((9, 8, 8), (9, 4), 7907)}
WEATHER = {"1-URGENT": "clear", "2-HIGH": "overcast", "3-MEDIUM": "rainy", "4-NOT SPECIFIED": "snowy", "5-LOW": "partly_cloudy"}
TIMES = {"F": "day", "O": "night", "P": "dawn"}
SCENES = ["city_street", "highway", "residential"]


#: Bytes of a file that one task reads. A task that deals its rows to over 200 others holds them meanwhile, and Spark's 128 MB can be tens of millions of rows.
SPLIT, SPARKS_SPLIT = 8 << 20, 128 << 20


@dataclass
class Views:
    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        name = "spark.sql.files.maxPartitionBytes"
        if self.spark.conf.get(name) in (f"{SPARKS_SPLIT}b", f"{SPARKS_SPLIT}", "128m", "128MB"):  # a size of the user's own stays
            self.spark.conf.set(name, str(SPLIT))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def image_tasks(self) -> int:
        """Tasks that boxes and detections are dealt to, by image: the number follows the rows, so that a task's share does not grow."""
        rows = self.table("lineitem")
        return tasks(rows, rows.count())

    def samples(self, *more: str) -> DataFrame:
        look = lambda c, m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(c)]
        return self.table("orders").select(
            F.col("o_orderkey").alias("image_id"),
            F.col("o_custkey").alias("group_id"),
            F.lit(1280).alias("width"),
            F.lit(720).alias("height"),
            look("o_orderstatus", TIMES).alias("timeofday"),
            look("o_orderpriority", WEATHER).alias("weather"),
            F.element_at(F.array(*map(F.lit, SCENES)), (F.col("o_custkey") % 3 + 1).cast("int")).alias("scene"),
            *more,
        )

    def dealt_samples(self) -> DataFrame:
        """The samples where the boxes and detections of their images lie."""
        return self.samples().repartition(self.image_tasks, "image_id")

    def boxes(self) -> DataFrame:
        """Line items as boxes, with the amount in cents that drives the synthetic models."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        return self.table("lineitem").repartition(self.image_tasks, "l_orderkey").select(
            F.col("l_orderkey").alias("image_id"),
            F.row_number().over(order).cast("long").alias("box_id"),
            (F.col("l_partkey") % 8).cast("int").alias("cls"),
            ((F.col("l_partkey") * 37) % 1100).alias("x"),
            ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 17) % 590).alias("y"),
            (F.col("l_quantity").cast("long") * 3 + 8).alias("w"),
            ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 110 + 8).alias("h"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        )

    def gt(self) -> DataFrame:
        d = lambda c: c.cast("double")
        x, y, w, h = map(F.col, "xywh")
        return self.boxes().select("image_id", "box_id", "cls", d(x).alias("x1"), d(y).alias("y1"), d(x + w).alias("x2"), d(y + h).alias("y2"))

    def det(self, model: str = "baseline", only: str | None = None) -> DataFrame:
        """A model's detections; with `only` (SQL over a sample's attributes) those of such images, which are then the only ones to be ordered and matched."""
        (day, night, dawn), (step, shift), times = MODELS["baseline" if model == "noisy" else model]
        d = lambda c: c.cast("double")
        c, x, y, w, h = map(F.col, ("cents", "x", "y", "w", "h"))
        orders = self.table("orders") if only is None else self.samples("o_orderkey", "o_custkey", "o_orderstatus").filter(only)
        status = orders.select(F.col("o_orderkey").alias("image_id"), "o_orderstatus")
        kept = F.when(F.col("o_orderstatus") == "F", day).when(F.col("o_orderstatus") == "O", night).otherwise(dawn)
        found = self.boxes().join(status, "image_id").filter(c % 10 < kept)
        found = found.select(
            "image_id",
            F.col("box_id").alias("det_id"),
            F.when(c % 17 == 0, (F.col("cls") + 1) % 8).otherwise(F.col("cls")).cast("int").alias("cls"),
            d(x + (c % step - shift)).alias("x1"),
            d(y + (c % 11 - 5)).alias("y1"),
            d(x + w + (c % 7 - 3)).alias("x2"),
            d(y + h + (c % 5 - 2)).alias("y2"),
            (((c * times) % 10007) / 10007.0).alias("score"),
            *[(c % 23 == 0).alias("_again")] * (model == "noisy"),
        )
        if model == "noisy":  # some detections once more, beside themselves
            copied = found.withColumn("_copy", F.explode(F.when(F.col("_again"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
            moved = {"det_id": F.col("det_id") + 500, "x1": F.col("x1") + 1, "score": F.col("score") * 0.9}
            found = copied.withColumns({n: F.when(F.col("_copy"), x).otherwise(F.col(n)) for n, x in moved.items()}).drop("_again", "_copy")
        k, g = F.col("o_orderkey"), F.col("o_custkey")
        false = orders.filter(k % 3 == 0).repartition(self.image_tasks, "o_orderkey").select(
            k.alias("image_id"),
            F.lit(1000).cast("long").alias("det_id"),
            (g % 8).cast("int").alias("cls"),
            d(g % 1000).alias("x1"),
            d((g * 13) % 500).alias("y1"),
            d(g % 1000 + 60).alias("x2"),
            d((g * 13) % 500 + 40).alias("y2"),
            (((k * 6101) % 10007) / 10007.0).alias("score"),
        )
        return found.unionByName(false)  # both are dealt by image to the same tasks, and stay so
