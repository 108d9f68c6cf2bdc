"""Vectors as matrices inside tasks, and sums over all rows that meet in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in a row of a partial sum, and groups that partial sums of one chunk are dealt to before they meet.
CHUNK, SALTS = 4096, 64
_PARTIAL = pa.schema([("chunk", pa.int32()), ("salt", pa.int32()), ("t", pa.list_(pa.float64()))])


def finite(column: str) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    good = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(column) > 0) & good, F.lit(False))


def clean(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and e (doubles) of the rows whose vector takes part."""
    return rows.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("e")).filter(finite("e"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix; lists of unequal lengths raise."""
    if not len(column):
        return np.zeros((0, 0))
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def width(rows: DataFrame, column: str = "e") -> int:
    """Components of the vectors, 0 without rows; vectors of unequal lengths raise."""
    low, high = rows.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} components")
    return low or 0


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of `part` (so many numbers) over all batches.

    Each task sends its own sum in chunks; a chunk's sums meet in salted groups and then in one, so no group holds more than CHUNK numbers
    for each of 1/SALTS of the tasks. The driver receives `size` numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch).reshape(-1)
        if total.any():
            cuts = range(0, size, CHUNK)
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([salt] * len(cuts), pa.int32()), pa.array([total[a : a + CHUNK] for a in cuts], pa.list_(pa.float64()))], schema=_PARTIAL)

    def meet(got: pa.Table) -> pa.Table:
        lists = got.column("t").combine_chunks()
        return pa.table([got.column("chunk")[:1], got.column("salt")[:1], pa.array([matrix(lists).sum(axis=0)], pa.list_(pa.float64()))], schema=_PARTIAL)

    ddl = "chunk int, salt int, t array<double>"
    parts = rows.mapInArrow(run, ddl).groupBy("chunk", "salt").applyInArrow(meet, ddl).groupBy("chunk").applyInArrow(meet, ddl)
    out = np.zeros(size)
    for r in parts.select("chunk", "t").collect():  # `size` numbers in all
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(r.t)] = r.t
    return out
