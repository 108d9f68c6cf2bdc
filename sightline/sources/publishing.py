"""Publishing a run: the whitelisted files of its folder, its texts scrubbed of the paths of the machine it ran on.

Texts are rows of (file, text): Spark reads, edits and writes them, and each row becomes a file of its own name. The driver handles only names. Other
files (weights, pictures) are copied as they are. The published folder appears once and complete.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import files

# What is published, below the run's folder; a star stands for part of a name, and a folder for all that lies in it.
WHITELIST = [
    "config.json", "status.json", "metrics.jsonl", "eval/*.json", "stages/*.json", "monitor/monitor.json", "mine/probe_eval.json", "analyze/analysis.json", "analyze/thumbs/",
    "synthesize/synthesis.json", "synthesize/synthetic/summary.json", "synthesize/synthetic/plan.json", "synthesize/synthetic/gallery/", "synthesize/augment/summary.json",
    "synthesize/augment/gallery/", "gate/gate.json", "report/",
]
# The suffixes of texts.
TEXTS = (".json", ".jsonl", ".md", ".txt", ".yaml")
MINED, SUMMARY = "mine/mined.json", "mine/mined_summary.json"


def whitelisted(file: Column, patterns: list[str] | None = None) -> Column:
    one = [re.escape(p).replace(r"\*", "[^/]*") + (".*" if p.endswith("/") else "") for p in (patterns or WHITELIST)]
    return file.rlike("^(" + "|".join(one) + ")$")


def scrubbed(text: Column, roots: dict[str, str]) -> Column:
    """The text with each root, as it is, with slashes, and as JSON writes it, replaced by its tag; longer forms first."""
    forms = {}
    for root, tag in roots.items():
        for form in (root, root.replace("\\", "/"), root.replace("\\", "\\\\")):
            forms[form] = tag
    for form in sorted(forms, key=lambda f: (-len(f), f)):
        text = F.replace(text, F.lit(form), F.lit(forms[form]))
    return text


def _edited(file: Column, text: Column) -> Column:
    """Without process ids in the status, with the bare name of the weights in evaluations, and of the mined errors only the summary."""
    number = r'"pid"\s*:\s*(null|-?\d+)'
    status = F.regexp_replace(F.regexp_replace(text, r",\s*" + number, ""), number + r"\s*,?\s*", "")
    weights = F.regexp_replace(text, r'("model"\s*:\s*\{[^{}]*"weights"\s*:\s*")[^"]*[/\\]([^"/\\]*")', "$1$2")
    return F.when(file == "status.json", status).when(file.rlike(r"^eval/[^/]*\.json$"), weights).when(file == MINED, F.get_json_object(text, "$.summary")).otherwise(text)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """file (below the folder) and path of all files of a folder; nothing is read of them."""
    where, system = files._system(spark, folder)
    root = system.makeQualified(where).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return found.select(F.substring("path", len(root) + 1, 1_000_000).alias("file"), "path")


def read_texts(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """file and text of the texts of a folder (or of the named files), whole; each lies in one row, as the summaries of a run may."""
    every = listed(spark, folder).filter(F.lower("file").rlike("(" + "|".join(map(re.escape, TEXTS)) + ")$"))
    wanted = every.collect() if names is None else every.filter(F.col("file").isin(*names)).collect()  # names of files
    if not wanted:
        return spark.createDataFrame([], "file string, text string")
    held = spark.read.format("binaryFile").load([r.path for r in wanted])
    return held.join(F.broadcast(spark.createDataFrame(wanted)), "path").select("file", F.decode("content", "UTF-8").alias("text"))


def write_texts(texts: DataFrame, folder: str) -> int:
    """Writes each row (file, text) as the file of that name; returns their number. A text's last line ends with a line feed, whether it did or not."""
    spark, staged = texts.sparkSession, files.staging(folder)
    one = F.when(F.col("n") == 1, F.regexp_replace("text", "\n$", "")).otherwise(F.raise_error(F.concat(F.lit("two texts have one name: "), "file")))
    named = texts.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    named.select("file", one.alias("value")).write.partitionBy("file").text(staged)  # a folder for each text, whose name carries the file's
    written = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(staged).select("path", "file").collect()  # names of files
    for r in written:
        files.publish(spark, r.path, f"{folder}/{r.file}")
    where, system = files._system(spark, staged)
    system.delete(where, True)
    return len(written)


def publish(spark: SparkSession, run: str, target: str, roots: dict[str, str], patterns: list[str] | None = None, replace: bool = False) -> list[str]:
    """Publishes a run and returns the names of its files. `roots` are paths with the tags that replace them. A target that exists raises, unless it may be replaced."""
    if files.exists(spark, target) and not replace:
        raise ValueError(f"{target} exists already")
    names = {r.file: r.path for r in listed(spark, run).collect()}  # names of files
    wanted = {r.file for r in spark.createDataFrame([(n,) for n in names] or [("",)], "file string").filter(whitelisted(F.col("file"), patterns)).collect()}
    is_text = lambda n: n.lower().endswith(TEXTS)
    staged = files.staging(target.rstrip("/").rpartition("/")[0] or ".")
    texts = [n for n in wanted if is_text(n)] + ([MINED] if MINED in names else [])
    if texts:
        held = read_texts(spark, run, texts)
        named = F.when(F.col("file") == MINED, F.lit(SUMMARY)).otherwise(F.col("file"))
        edited = scrubbed(_edited(F.col("file"), F.col("text")), roots)
        write_texts(held.select(named.alias("file"), F.coalesce(edited, F.lit("null")).alias("text")), staged)
    copies = {n: n for n in wanted if not is_text(n)} | ({"baseline/weights.pt": "weights/baseline.pt"} if "baseline/weights.pt" in names else {})
    if "gate/gate.json" in names:
        chosen = read_texts(spark, run, ["gate/gate.json"]).select(F.get_json_object("text", "$.candidate")).first()[0]
        if f"retrain/{chosen}/weights.pt" in names:
            copies[f"retrain/{chosen}/weights.pt"] = f"weights/{chosen}.pt"
    for name, new in copies.items():
        files.copy(spark, names[name], f"{staged}/{new}")
    if replace:
        where, system = files._system(spark, target)
        system.delete(where, True)
    if not files.publish(spark, staged, target):
        raise ValueError(f"{target} exists already")
    return sorted([SUMMARY if n == MINED else n for n in texts] + list(copies.values()))
