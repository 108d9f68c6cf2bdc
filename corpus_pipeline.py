"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

1. quality rules: documents that the rules reject go;
2. quality classifier: documents scored below `MIN_SCORE` go (the model learns from the labels of `sf_dir` outside its held-out fold);
3. n-gram Jaccard join: one document of each component stays, that of the smallest doc_id;
4. substring dedup: words in repeated windows go from the texts (a text without them stays as it is), and a document of which nothing is left goes too;
5. best-fit packing: token pieces of what is left, with their ids and their place in sequences.

All stages but the last return the columns of `documents`; n_chars follows the text. SQL cannot express the classifier, so there is
no ORACLE_SQL; tests hold the stages against brute force on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import near_duplicates, packing, quality_model, quality_rules, substring_dedup
from sightline.llm.common import Scratch, table

MIN_SCORE = 0.5


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality_model.train(table(spark, sf_dir, "documents"), quality_model.training_labels(spark, sf_dir))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return quality_model.score(docs, weights, name).filter(F.col(name) >= MIN_SCORE).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup.reduced(docs, as_is=True).filter("n_words > n_removed")
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("int")}
    return found.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=True)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", near_copies), ("substring dedup", substrings), ("best-fit packing", sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
