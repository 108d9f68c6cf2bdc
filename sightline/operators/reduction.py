"""Principal components of vectors.

Two passes form the mean and the centred second moments inside tasks; only d * d numbers leave them. The projection is a third pass over the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.vectors import clean, matrix, summed, width


def axes(rows: DataFrame, n: int, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the first k axes (rows; the largest loading of each is positive, the first of equal ones), and the variance along each."""
    mean = summed(rows.select("e"), lambda b: matrix(b.column(0)).sum(axis=0) if b.num_rows else np.zeros(dim), dim) / n

    def second(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0)) - mean if batch.num_rows else np.zeros((0, dim))
        return x.T @ x

    moments = summed(rows.select("e"), second, dim * dim).reshape(dim, dim)
    values, vectors = np.linalg.eigh((moments + moments.T) / 2)
    order = np.argsort(values)[::-1][:k]
    found = vectors[:, order].T
    largest = found[np.arange(len(found)), np.abs(np.round(found, 12)).argmax(axis=1)]
    return mean, found * np.where(largest < 0, -1.0, 1.0)[:, None], np.maximum(values[order], 0) / max(n - 1, 1)


def pca(vectors: DataFrame, components: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and z: the coordinates along the first `components` axes (as many as rows and dimensions allow).

    With at most `components` + 2 rows, z has the vector's own first components instead, and zeros where there are none.

    Rows whose vector is null, empty, or holds null or non-finite components are left out, vectors of unequal lengths raise, repeated rows each
    count, and an empty table gives no rows.
    """
    rows = clean(vectors, key, column)
    n, dim = rows.count(), width(rows)
    if n <= components + 2:
        own = F.slice("e", F.lit(1), F.least(F.lit(components), F.size("e")))
        return rows.select("vec_id", F.concat(own, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(components) - F.size("e")))).alias("z"))
    mean, found, _ = axes(rows, n, dim, min(components, dim, n))

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                z = (matrix(batch.column(1)) - mean) @ found.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["vec_id", "z"])

    return rows.mapInArrow(project, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, z array<double>")
