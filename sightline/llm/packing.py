"""Best-fit packing of token pieces into sequences of bounded length.

Hierarchical residual packing: every partition packs its items best-fit (longest first; a large one a run of items at a time), nearly full
bins are final, and the underfull bins of all partitions are items of the next, narrower round. A round's
partitions hold at most `ITEMS_PER_TASK` items, and rounds end when one partition holds what is left
or a round no longer frees bins, so no task grows with the input.

Defined cases: a null or empty text is a document of the end id alone; an item longer than the
capacity is cut, its first piece the shorter one; repeated rows are packed once each; ties between items
go by input order; an empty table gives no rows; columns that the operator does not use are
left out of `pack_documents` and kept by `pack` (whatever their names, but for the three it adds).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import Scratch, list_array, table
from sightline.llm.tokens import encoder, vocabulary

NAME = "op1_best_fit_packing"
CAPACITY = 2048
END_ID = 0
#: Items that one task packs at most, once the first round has read them.
ITEMS_PER_TASK = 200_000
#: The same for tokens, as items may carry their ids.
TOKENS_PER_TASK = 10_000_000
#: Tokens that the first round packs at a time, whatever the size of a partition.
FIRST_TOKENS = 4_000_000
#: Bins sent at a time, which bounds what a batch weighs when items carry their ids; and documents encoded at a time.
ROWS, ENCODED = 256, 500
#: A bin with this many free places or fewer is final.
SLACK = 8


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: items in the order they were placed, and the bin of each.

    Free space is at most `capacity`, so open bins are kept by their free places, and a bit mask of the
    sizes in use gives the tightest fit in constant time.
    """
    order = np.argsort(-lengths, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n, bins = 0, 0, np.empty(len(order), np.int64)
    for k, size in enumerate(lengths[order].tolist()):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                mask ^= 1 << free
        else:
            b, free = n, capacity
            n += 1
        bins[k] = b
        if free > size:
            left = free - size
            open_bins[left].append(b)
            mask |= 1 << left
    by_bin = np.argsort(bins, kind="stable")
    return order[by_bin], bins[by_bin]


def pack(items: DataFrame, length: str, capacity: int = CAPACITY, slack: int = SLACK, made_by=None, schema: T.StructType | None = None) -> DataFrame:
    """Adds sequence_id, sequence_offset and sequence_length to items of 1 to `capacity` tokens.

    An item keeps its place in its bin beside it, and gets a new one when bins are packed together.

    With `made_by`, the rows of `items` become items of `schema` by that function of Arrow batches, in the tasks of the first round.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    fields = T.StructType([T.StructField(f.name, f.dataType, True) for f in (schema or items.schema).fields])
    place = "place"
    while place in fields.names:
        place += "_"
    placed = T.StructType(fields.fields + [T.StructField(place, T.LongType())])
    binned = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("fill", T.IntegerType()), T.StructField("items", T.ArrayType(placed))])

    def round_of(number: int, nested: bool):
        def run(batches):
            held, tokens, made, rows = [], 0, 0, 0
            for batch in made_by(batches) if made_by and not nested else batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                rows += batch.num_rows
                tokens += pc.sum(batch.column(batch.schema.get_field_index("fill" if nested else length))).as_py()
                if not nested and tokens >= FIRST_TOKENS:
                    yield from packed(held, made)
                    made, held, tokens = made + rows, [], 0
                    rows = 0
            if held:
                yield from packed(held, made)

        def packed(batches, made):
            got = pa.Table.from_batches(batches).combine_chunks()
            batches.clear()
            if nested:
                held = got.column("items").combine_chunks()
                counts = np.diff(held.offsets.to_numpy())
                flat = held.flatten()
                fills = got.column("fill").to_numpy().astype(np.int64)
            else:
                flat = pa.StructArray.from_arrays([c.combine_chunks() for c in got.columns], names=got.column_names)
                counts = np.ones(len(flat), np.int64)
                fills = got.column(length).to_numpy().astype(np.int64)
            order, bins = best_fit(fills, capacity)
            starts = np.cumsum(counts) - counts
            take = np.repeat(starts[order] - (np.cumsum(counts[order]) - counts[order]), counts[order]) + np.arange(int(counts.sum()))
            n = int(bins.max()) + 1
            fill = np.bincount(bins, weights=fills[order], minlength=n).astype(np.int32)
            size = np.bincount(bins, weights=counts[order], minlength=n).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            lengths = flat.field(length).to_numpy(zero_copy_only=False).astype(np.int64)[take]
            at = np.cumsum(lengths) - lengths - np.repeat(np.cumsum(fill, dtype=np.int64) - fill, size)
            ids = (number << 56) + (TaskContext.get().partitionId() << 32) + made + np.arange(n, dtype=np.int64)
            for a in range(0, n, ROWS):
                b = min(n, a + ROWS)
                own = slice(first[a], first[b])
                columns = flat.take(pa.array(take[own])).flatten()[: len(fields)]
                part = pa.StructArray.from_arrays([*columns, pa.array(at[own])], names=placed.names)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(fill[a:b]), list_array(part, size[a:b])], names=["sequence_id", "fill", "items"])

        return run

    done, number = [], 0
    now = scratch.save(items.mapInArrow(round_of(0, False), binned), "round0")
    left = None
    while True:
        full, rest = now.filter(F.col("fill") >= capacity - slack), now.filter(F.col("fill") < capacity - slack)
        count, tokens = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("fill"), F.lit(0))).first()
        tasks = max(math.ceil(count / ITEMS_PER_TASK), math.ceil(tokens / TOKENS_PER_TASK))
        settled = left is not None and (left[0] == 1 or count > 0.95 * left[1])
        if not count or settled:
            done.append(now)
            break
        done.append(full)
        number += 1
        now = scratch.save(rest.repartition(tasks).mapInArrow(round_of(number, True), binned), f"round{number}")
        left = (tasks, count)
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    # items leave their bins in Spark: whole bins need not pass through Arrow again
    n = len(fields)
    flat = bins.select("sequence_id", "fill", F.inline("items")).toDF(*[f"c{k}" for k in range(n + 3)])
    order = [*range(2, n + 2), 0, n + 2, 1]
    names = [*fields.names, "sequence_id", "sequence_offset", "sequence_length"]
    return flat.select(*[F.col(f"c{k}").cast("long").alias(name) if k < 2 else F.col(f"c{k}").alias(name) for k, name in zip(order, names, strict=True)])


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    """The function from batches of (doc_id, text) to batches of pieces, and their schema."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(ids), ENCODED):
                out = []
                for doc, coded in zip(ids[a : a + ENCODED], encode(texts.slice(a, ENCODED).to_pylist()), strict=True):
                    coded += end
                    n, at, k = len(coded) // 4, 0, 0
                    while at < n:
                        size = (n - 1) % capacity + 1 if at == 0 else capacity
                        part = coded[4 * at : 4 * (at + size)]
                        out.append((doc, k, at, size, zlib.crc32(part), part) if with_ids else (doc, k, at, size, zlib.crc32(part)))
                        at, k = at + size, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    kinds = [T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.LongType()] + [T.BinaryType()] * with_ids
    return run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The token pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32 bits)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(*_cut(path or vocabulary("byte_bpe_50k.json"), capacity, end_id, with_ids))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the place there."""
    made_by, schema = _cut(path or vocabulary("byte_bpe_50k.json"), capacity, end_id, with_ids)
    return pack(docs.select(F.col("doc_id").cast("long"), "text"), "length", capacity, made_by=made_by, schema=schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("sequence_offset").alias("offset"))
