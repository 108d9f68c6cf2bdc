"""Shared helpers of the training-data operators: inputs, scratch tables, word hashes."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets that a table may have by Spark's own default setting.
MAX_BUCKETS = 100_000
#: Word separators of every word-based operator: space and the ASCII controls tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sightline")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    They stay until the session's driver ends, unless they are dropped before.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, f"{label}_{uuid.uuid4().hex}"
        self.root, self.tables = f"{shared_dir(spark)}/{self.label}", []
        atexit.register(self._end)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Saved in buckets of a column: grouping or joining on it later moves none of these rows."""
        table_name = f"{self.label}_{name}"
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}")
        writer.bucketBy(min(buckets, MAX_BUCKETS), key).saveAsTable(table_name)
        self.tables.append(table_name)
        return self.spark.table(table_name)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _end(self) -> None:
        self._remove(self.root)
        for name in self.tables:
            try:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            except Exception:  # the session may have ended before the interpreter does
                pass

    def _remove(self, where: str) -> None:
        try:
            jvm, jsc = self.spark._jvm, self.spark._jsc
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # as above
            pass


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


# ---------------------------------------------------------------- word hashes


def _splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _splitmix
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _byte_table(seed: int, lower: bool) -> np.ndarray:
    at = np.arange(256, dtype=np.uint64)
    if lower:
        at[65:91] += np.uint64(32)
    return _splitmix((at + np.uint64(1 + 1000 * seed)) * _GOLD)


_BYTES = {(seed, lower): _byte_table(seed, lower) for seed in (0, 1) for lower in (False, True)}
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int, seed: int = 0) -> np.ndarray:
    """1, s, s^2, ... modulo 2^64; n of them at least."""
    if len(_POWERS[seed]) < n:
        out = np.full(max(n, 2 * len(_POWERS[seed])), _STEP[seed], np.uint64)
        out[0] = 1
        _POWERS[seed] = np.multiply.accumulate(out)
    return _POWERS[seed]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 21) -> list[tuple[int, int]]:
    """Runs of documents of about `limit` bytes; one longer document is a run of its own."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out


class Words:
    """The words of a run of documents: byte spans, and the count up to each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _WS):
        self.data, self.offsets = data, offsets
        word = ~space[data]
        first = word.copy()
        if len(data):
            first[1:] &= ~word[:-1]
            starts = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[starts] = word[starts]
        last = np.zeros(len(data), bool)
        if len(data):
            last[:-1] = word[:-1] & (~word[1:] | first[1:])
            last[-1] = word[-1]
        self.inside, self.start, self.end = word, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of_doc = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        value = _BYTES[seed, lower][self.data[self.inside]] * powers(int(size.max()), seed)[at]
        total = np.add.reduceat(value, np.cumsum(size) - size)
        return _splitmix(total + size.astype(np.uint64) * _GOLD)

    def count(self) -> np.ndarray:
        return np.diff(self.of_doc)


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k hashes (also of runs that cross documents; the caller leaves those out)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    step, done, out, at = powers(k + 1, seed), 0, None, 0
    size, block = 1, h
    while True:  # blocks of 1, 2, 4, ... words, joined by the bits of k
        if k & size:
            n = len(h) - k + 1
            part = block[at : at + n] * step[at]
            out = part if out is None else out + part
            at += size
        done = size * 2
        if done > k:
            return _splitmix(out + np.uint64(k))
        block = block[: len(block) - size] + block[size:] * step[size]
        size = done


def in_one_doc(of_doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of k words that lie in one document, and the document of each."""
    n = np.maximum(np.diff(of_doc) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + of_doc[:-1][doc]
    return at, doc


def list_array(flat: pa.Array, counts) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def flatten(parts) -> list:
    return list(itertools.chain.from_iterable(parts))
