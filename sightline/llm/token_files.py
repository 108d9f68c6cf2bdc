"""Token-id files: frequency-ranked ids in byte-aligned variable-length code.

A shard is a run of documents in ascending doc_id order, kept as blocks of about `BLOCK_IDS` ids. A block is
one binary value:

    magic "RVB2" | documents u32 | of these without doc_id (the first ones) u32 | ids u64 | control bytes u64 | data bytes u64
    doc ids i64[] | ids per document u32[] | control bytes | data bytes

Ids are replaced by their frequency rank over all documents (ties: smaller id first). Four ranks share a control byte, two bits
each: the bytes of the rank less one. Decoding looks the four lengths up by control byte in a numpy
table. The ranks are a dictionary file beside the blocks. Both are Parquet tables with a binary column, so
that Spark's committer covers lost executors and any file system that Spark reaches will do.

Defined cases: a null or empty text has the end id alone; documents of one doc_id lie next to each other, in the
order of a hash of their ids (repeated rows each take their place); a null doc_id comes first and is null when read; an empty table gives no blocks;
other columns are left out; a very long text is one document of one block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, table
from sightline.llm.tokens import encoder, runs, vocabulary

NAME = "op2_token_files"
END_ID = 2
BLOCK_IDS = 1_000_000
MAGIC = b"RVB2"
_HEAD = struct.Struct("<4sIIQQQ")
#: Bytes of ids in a shard, about, and shards at least.
SHARD_BYTES, SHARDS = 16 << 20, 8
#: The four byte lengths of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_block(doc_ids: list, counts: list[int], ranks: np.ndarray) -> bytes:
    """Documents without id come first."""
    control, data = encode_ranks(ranks)
    nulls = sum(d is None for d in doc_ids)
    ids = np.array([0] * nulls + doc_ids[nulls:], "<i8")
    return b"".join([_HEAD.pack(MAGIC, len(ids), nulls, len(ranks), len(control), len(data)), ids.tobytes(), np.array(counts, "<u4").tobytes(), control, data])


def decode_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Doc ids, ids per document, ranks."""
    magic, docs, nulls, n, control, data = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of ranked ids")
    at = _HEAD.size
    ids = np.frombuffer(block, "<i8", docs, at)
    counts = np.frombuffer(block, "<u4", docs, at + 8 * docs)
    at += 12 * docs
    ranks = decode_ranks(np.frombuffer(block, np.uint8, control, at), np.frombuffer(block, np.uint8, data, at + control), n)
    return [None] * nulls + ids[nulls:].tolist(), counts, ranks


def _coded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Each document's ids, end id included, two bytes each where all ids of the vocabulary fit.

    A task adds a last row with its id counts, n of which is null.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        own = encoder(path)
        kind, total = _kind(len(own.size), end_id), np.zeros(1 << 16, np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, rows in runs(texts):
                coded = [x + end for x in own.encode(texts.slice(a, rows).to_pylist())]
                n = np.array([len(x) for x in coded], np.int64) // 4
                flat = np.frombuffer(b"".join(coded), "<u4")
                got = np.bincount(flat)
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
                offsets = (np.concatenate([[0], np.cumsum(n)]) * np.dtype(kind).itemsize).astype(np.int64)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([ids.slice(a, rows), pa.array(n), packed.cast(pa.binary())], names=["doc_id", "n", "coded"])
        used = np.flatnonzero(total)
        counts = np.stack([used, total[used]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([counts], pa.binary())], names=["doc_id", "n", "coded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, coded binary")


def _kind(vocabulary_size: int, end_id: int) -> str:
    return "<u2" if max(vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"


def _frequencies(coded: DataFrame) -> DataFrame:
    """Sums of the tasks' counts: a row an id and task, at most the vocabulary a task."""
    def run(batches):
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                ids, n = np.frombuffer(counts, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "count"])

    return coded.filter("n is null").select("coded").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


class TokenFiles:
    """A written set of token-id files: `blocks` (shard, block, n_ids, payload) and `ranks` (rank, id, count)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.blocks = spark.read.parquet(f"{root}/blocks")
        self.ranks = spark.read.parquet(f"{root}/ranks")

    def documents(self) -> DataFrame:
        """doc_id, start (ids before the document), n_tokens, ids (little-endian 32 bits), ids_crc32, as decoded."""
        # the dictionary is as large as the vocabulary, whatever the input
        id_of = np.array([r.id for r in self.ranks.orderBy("rank").collect()], np.uint32)
        by_rank = self.spark.sparkContext.broadcast(id_of)
        # running sums within each shard, on top of those over the shards (a row for each); both read the block headers only
        before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shards = self.blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", before(Window.orderBy("shard")).alias("shard_start"))
        starts = self.blocks.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("in_shard")).join(shards, "shard")
        starts = starts.select("shard", "block", (F.col("in_shard") + F.col("shard_start")).alias("block_start"))

        def run(batches):
            table_of_ids = by_rank.value
            for batch in batches:
                for shard, block, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    docs, counts, ranks = decode_block(payload)
                    ids, at = table_of_ids[ranks].astype("<u4"), np.cumsum(counts, dtype=np.int64) - counts
                    parts = [ids[a : a + n].tobytes() for a, n in zip(at.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(at, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(parts, pa.binary()), pa.array([zlib.crc32(p) for p in parts], pa.int64())],
                        names=["shard", "block", "doc_id", "at", "n_tokens", "ids", "ids_crc32"],
                    )

        read = self.blocks.select("shard", "block", "payload").mapInArrow(run, "shard int, block int, doc_id long, at long, n_tokens long, ids binary, ids_crc32 long")
        read = read.join(starts, ["shard", "block"])
        return read.select("doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids", "ids_crc32")


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, root: str | None = None) -> TokenFiles:
    """Encodes all documents and writes the files below `root` (a scratch folder where none is given)."""
    spark, path = docs.sparkSession, path or vocabulary("byte_bpe_50k.json")
    scratch = Scratch(spark, "tokens")
    root = root or f"{scratch.root}/files"
    coded = scratch.save(_coded(docs, path, end_id), "coded")
    counts = scratch.save(_frequencies(coded), "counts")
    ranked = counts.orderBy(F.desc("count"), "id").collect()  # a row for each id of the vocabulary at most
    id_of = np.array([r.id for r in ranked], np.int64)
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    spark.createDataFrame([(k, r.id, r["count"]) for k, r in enumerate(ranked)], "rank long, id long, count long").coalesce(1).write.parquet(f"{root}/ranks")
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        ranks_of, shard, number, size = shared.value, TaskContext.get().partitionId(), 0, 0
        held: tuple[list, list, list] = ([], [], [])

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([sum(held[1])], pa.int64()), pa.array([encode_block(held[0], held[1], np.concatenate(held[2]))], pa.binary())],
                names=["shard", "block", "n_ids", "payload"],
            )

        for batch in batches:
            for doc, n, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held[0].append(doc)
                held[1].append(n)
                held[2].append(ranks_of[np.frombuffer(c, f"<u{len(c) // n}")])
                size += n
                if size >= BLOCK_IDS:
                    yield block()
                    number, size, held = number + 1, 0, ([], [], [])
        if held[0]:
            yield block()

    rows = coded.filter("n is not null").withColumn("order", F.xxhash64("coded"))
    shards = max(SHARDS, (coded.agg(F.sum("n")).first()[0] or 0) * 2 // SHARD_BYTES)
    ordered = rows.repartitionByRange(shards, "doc_id", "order").sortWithinPartitions("doc_id", "order").select("doc_id", "n", "coded")
    ordered.mapInArrow(run, "shard int, block int, n_ids long, payload binary").write.parquet(f"{root}/blocks")
    scratch.drop("coded", "counts")
    return TokenFiles(spark, root)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"))
    return files.documents().select("doc_id", "start", "n_tokens", "ids_crc32")
