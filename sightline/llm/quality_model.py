"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

Features are words and word pairs, each in two spellings: as they stand (A-Z lower-cased), and as their shape (runs of
letters, capitals, digits and each sign reduced to one character). They are hashed to `BUCKETS` places; a
text is the vector of 1 + log(count), scaled to length 1. A score is the logistic function of a sparse dot product.

Training takes at most `MAX_TRAINING` labelled texts, those with the smallest hash of their doc_id. They
are dealt to groups of about `SHARD_ROWS`, each trained by FTRL-proximal with `EPOCHS` passes, and the groups' weights are
averaged (one round of parameter mixing). The model is BUCKETS numbers, whatever the input.

Defined cases: null and empty texts have the score of the bias alone; labels without a matching text, or with a null label, teach
nothing; several labels of one document all count; without labels of both kinds all scores are 0.5;
columns other than doc_id and text play no part in a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import Words, mix, pieces, table, text_buffers

NAME = "op10_quality_classifier"
BUCKETS = 1 << 18
#: Labelled texts used for training, at most.
MAX_TRAINING = 20_000
#: Rows that a group trains on, about; fewer groups on fewer rows.
SHARD_ROWS = 2_500
EPOCHS = 4
#: Rates and penalties of the FTRL-proximal updates.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.001, 0.001
_PAIR, _SHAPE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)

#: Class of each byte in a word's shape.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def _shapes(words: Words) -> Words:
    """The same words with each run of one class reduced to one byte."""
    kinds = _CLASS[words.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | ~words.inside[1:] | ~words.inside[:-1]
    keep[words.start] = True
    keep[words.offsets[:-1][words.offsets[:-1] < len(kinds)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return Words(kinds[keep], at[words.offsets])


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and value of all features of a run of documents, sorted by document and bucket."""
    plain = Words(data, offsets)
    keys, docs = [], []
    for words, salt in ((plain, np.uint64(0)), (_shapes(plain), _SHAPE)):
        h = mix(words.hashes(lower=not salt) + salt)
        doc = np.repeat(np.arange(len(offsets) - 1), words.count())
        keys.append(h)
        docs.append(doc)
        same = doc[1:] == doc[:-1]
        keys.append(mix(h[:-1] * _PAIR + h[1:])[same])
        docs.append(doc[1:][same])
    key = np.concatenate(docs).astype(np.uint64) * np.uint64(buckets) + (np.concatenate(keys) % np.uint64(buckets))
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(key)))
    doc, bucket = (key[at] // np.uint64(buckets)).astype(np.int64), (key[at] % np.uint64(buckets)).astype(np.int64)
    value = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(doc, weights=value**2, minlength=len(offsets) - 1))
    return doc, bucket, value / norm[doc]


def _vectors(texts: DataFrame, buckets: int) -> DataFrame:
    """label, shard and the sparse vector of each labelled text."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in pieces(offsets):
                lo = offsets[a]
                doc, bucket, value = features(data[lo : offsets[b]], offsets[a : b + 1] - lo, buckets)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([bucket[i:j].tolist() for i, j in zip(cut, cut[1:])], pa.list_(pa.int32())), pa.array([value[i:j].tolist() for i, j in zip(cut, cut[1:])], pa.list_(pa.float64()))],
                    names=["label", "shard", "at", "value"],
                )

    return texts.select("text", "label", "shard").mapInArrow(run, "label int, shard int, at array<int>, value array<double>")


def ftrl(labels: np.ndarray, at: list[np.ndarray], values: list[np.ndarray], buckets: int, epochs: int) -> np.ndarray:
    """Weights (the bias last) after FTRL-proximal passes over the rows in turn."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(labels)):
            i, x = at[k], values[k]
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[i] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_training: int = MAX_TRAINING, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """The averaged weights. `labels` has doc_id and label (0 or 1)."""
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    shards = max(1, min(known.count(), max_training) // shard_rows)
    known = known.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    # at most max_training rows of 16 bytes
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "label").limit(max_training))
    rows = _vectors(docs.select("doc_id", "text").join(chosen, "doc_id"), buckets)

    def fit(key, got):
        got = got.combine_chunks()
        y = got.column("label").to_numpy()
        at = [np.append(a, buckets) for a in got.column("at").to_pylist()]
        value = [np.append(v, 1.0) for v in got.column("value").to_pylist()]
        order = sorted(range(len(y)), key=lambda k: (at[k].tobytes(), int(y[k])))  # the same order however rows arrive
        w = ftrl(y[order], [at[k].astype(np.int64) for k in order], [value[k] for k in order], buckets, epochs)
        used = np.flatnonzero(w)
        return pa.table({"at": pa.array(used, pa.int32()), "w": w[used], "rows": np.full(len(used), len(y))})

    fitted = rows.groupBy("shard").applyInArrow(fit, "at int, w double, rows long")
    mean = fitted.groupBy("at").agg(F.sum(F.col("w") * F.col("rows")).alias("w")).toPandas()
    total = rows.groupBy("label").count().toPandas()
    weights = np.zeros(buckets + 1)
    if len(total) == 2:
        weights[mean["at"].to_numpy(int)] = mean["w"].to_numpy() / total["count"].sum()
    return weights


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """All columns of `docs` but any of that name, with the score added."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def run(batches):
        w = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            total = np.zeros(batch.num_rows)
            for a, b in pieces(offsets):
                lo = offsets[a]
                doc, bucket, value = features(data[lo : offsets[b]], offsets[a : b + 1] - lo, len(w) - 1)
                total[a:b] = np.bincount(doc, weights=value * w[bucket], minlength=b - a)
            out = 1 / (1 + np.exp(-np.clip(total + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def fold() -> F.Column:
    """crc32 of the doc_id as text, modulo 3; fold 1 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold() != 1)
    return labels.select("doc_id", F.col("quality").alias("label"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
