"""Exact top-k inner products by aggregation of sorted lists without random access.

Vectors are turned to integers. Candidates are dealt to blocks of at most `BLOCK` rows; in a block, each component is a sorted
list, read from the high end by queries with a positive weight there and from the low end by the others, the same
depth in all lists. At a depth, the components read so far are known; every other one lies between the list's end and the last
value read. That bounds each candidate's score from below and above, for all queries of a query block at once:

    upper = max(x, last high read) . q+  +  min(x, last low read) . q-
    lower = (x if read, else the list's far end) . q+ and q- likewise

Reading stops for a query when no outsider's upper bound reaches the k-th lower bound; what is left is resolved to full scores.
Bounds and scores are integers that the arithmetic used holds exactly; where doubles cannot, blocks are scored in whole numbers of any size, without bounds.

Queries are a stated set, cut into blocks of at most `QUERY_BLOCK` rows that are sent to every candidate block;
the best k of each pair of blocks meet by query.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; only vectors of equal length
meet; a query's own rows (all of its vec_id) are no candidates for it; repeated candidate rows each count; ties go
to the smaller vec_id; a score beyond 64 bits counts as the nearest long; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, table

NAME = "op7_exact_topk"
K = 5
SCALE = 256
QUERY_STEP = 50
BLOCK, QUERY_BLOCK = 4_096, 1_024
#: Depths at which bounds are compared, as shares of a list.
DEPTHS = (0.25, 0.5, 0.75)
#: The largest finite component, and the ends of a long.
LARGEST, LONG = 1.7976931348623157e308, (-(2**63), 2**63 - 1)


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components (as doubles) of the vectors that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole)
    # doubles of 2^53 and more are whole numbers already
    times = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))
    return some.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.when(F.abs(times(x)) < 2.0**53, F.floor(times(x)).cast("double")).otherwise(times(x))).alias("v"))


def _matrix(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<f8").reshape(n, -1)


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of (dim, block, n, ids, matrix), each of at most `size` vectors of one length."""
    rows = rows.repartition(max(1, -(-rows.count() // size)))

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        first, made = TaskContext.get().partitionId() << 32, itertools.count()

        def out(dim):
            ids, parts = held.pop(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([first + next(made)], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(parts)], pa.binary())],
                names=["dim", f"{name}_block", f"{name}_n", f"{name}_ids", f"{name}_matrix"],
            )

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values.to_numpy()
                ids, parts = held.setdefault(len(x), ([], []))
                ids.append(vec_id)
                parts.append(x.astype("<f8").tobytes())
                if len(ids) == size:
                    yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, f"dim int, {name}_block long, {name}_n int, {name}_ids binary, {name}_matrix binary")


def top_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, depths=DEPTHS, clip: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate row and score of the best k candidates of each query, by score (with `clip`, cut to a long), then vec_id."""
    largest = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if largest >= 2.0**53:  # beyond doubles: whole integers, no bounds
        whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
        exact = whole(q) @ whole(c).T
        exact = np.clip(exact, *LONG) if clip else exact
        rows, cols, scores = [], [], []
        for i in range(len(q)):
            own = np.flatnonzero(c_ids != q_ids[i])
            best = sorted(own.tolist(), key=lambda j: (-exact[i, j], c_ids[j]))[:k]
            rows += [i] * len(best)
            cols += best
            scores += [int(exact[i, j]) for j in best]
        return np.array(rows, int), np.array(cols, int), np.array(scores, object)
    kind = np.float32 if largest < 2.0**24 else np.float64
    x, plus, minus = c.astype(kind), np.maximum(q, 0).T.astype(kind), np.minimum(q, 0).T.astype(kind)
    lists = np.sort(x, axis=0)  # a sorted list for each component
    n = len(x)
    own = q_ids[:, None] == c_ids[None, :] if np.isin(q_ids, c_ids).any() else None
    upper = np.full((n, len(q)), np.inf, kind)
    if own is not None:
        upper[own.T] = -np.inf
    floor = np.full(len(q), -np.inf)
    for depth in depths:
        read = max(1, int(n * depth))
        high, low = lists[n - read], lists[read - 1]
        known_high, known_low = np.where(x >= high, x, lists[0]), np.where(x <= low, x, lists[-1])
        lower = known_high @ plus + known_low @ minus
        upper = np.maximum(x, high) @ plus + np.minimum(x, low) @ minus
        if own is not None:
            lower[own.T] = upper[own.T] = -np.inf
        if n > k:
            floor = np.maximum(floor, np.partition(lower, n - k, axis=0)[n - k])
        if int((upper >= floor).sum()) <= 4 * k * len(q):
            break
    cand, row = np.nonzero((upper >= floor) & (upper > -np.inf))
    scores = np.empty(len(row), np.int64)
    for a in range(0, len(row), 100_000):
        b = a + 100_000
        scores[a:b] = np.einsum("ij,ij->i", q[row[a:b]], c[cand[a:b]]).astype(np.int64)  # exact below 2^53
    order = np.lexsort((c_ids[cand], -scores, row))
    row, cand, scores = row[order], cand[order], scores[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    best = rank < k
    return row[best], cand[best], scores[best]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Both inputs have vec_id and integer components `v`."""
    scratch = Scratch(queries.sparkSession, "topk")
    held = scratch.save(_blocks(candidates, block, "c"), "candidates")
    asked = scratch.save(_blocks(queries, query_block, "q"), "queries")
    # each block of queries goes to each block of candidates of its length
    pairs = asked.join(held.select("dim", "c_block"), "dim").join(held, ["dim", "c_block"])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = {f: batch.column(f)[at].as_py() for f in ("q_n", "q_ids", "q_matrix", "c_n", "c_ids", "c_matrix")}
                q_ids, c_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["c_ids"], "<i8")
                row, cand, scores = top_of_block(q_ids, _matrix(r["q_matrix"], r["q_n"]), c_ids, _matrix(r["c_matrix"], r["c_n"]), k, clip=True)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row], pa.int64()), pa.array(c_ids[cand], pa.int64()), pa.array(scores.tolist(), pa.int64())], names=["query_id", "vec_id", "score"])

    near = pairs.select("q_n", "q_ids", "q_matrix", "c_n", "c_ids", "c_matrix").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter(F.col("vec_id") % QUERY_STEP == 0), vectors)


ORACLE_SQL = f"""
WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
