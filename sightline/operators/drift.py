"""Distances between two windows of vectors: maximum mean discrepancy and kernel distance, each over all rows in linear cost.

A window is a DataFrame of vec_id and embedding. Rows whose vector is null, or has null, NaN or infinite components, take no part; vectors of
unequal lengths raise. A distance that lacks pairs (a window of fewer than two rows) is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.hashing import uniform

#: Rows of the larger window in a block, on average: a block's kernel matrix has some (2 * BLOCK)^2 doubles.
BLOCK = 256
#: Values in a row of partial moments.
CHUNK = 4096

#: Odd steps of the keys, and the shifts and odd factors of the rounds that mix them in.
SEED_STEP, REPLICATE_STEP = 48_271, 2_654_435_769
MIX = ((16, 0x7FEB352D), (15, 0x846CA68B))

_SUMS = ["sxx", "nxx", "syy", "nyy", "sxy", "nxy"]


def _both(x: DataFrame, y: DataFrame) -> DataFrame:
    """side (0: x, 1: y), vec_id, e."""
    sides = [t.select(F.lit(s).alias("side"), "vec_id", F.col("embedding").cast("array<double>").alias("e")) for s, t in enumerate((x, y))]
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return sides[0].unionByName(sides[1]).filter(F.coalesce(finite, F.lit(False)))


def in_blocks(x: DataFrame, y: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of both windows with a block each, dealt by a hash; there are as many blocks as the larger window has `block` rows, one at least."""
    rows = _both(x, y)
    counts = rows.groupBy("side").count().agg(F.max("count").alias("n"))  # one row
    k = F.greatest(F.ceil(F.col("n") / block), F.lit(1))
    return rows.crossJoin(F.broadcast(counts)).select("side", "vec_id", "e", F.floor(uniform(0, F.col("vec_id")) * k).alias("block"))


def _distances(rows: pd.DataFrame) -> np.ndarray:
    z = np.array(rows["e"].tolist(), dtype=np.float64)
    squares = (z * z).sum(1)
    return np.maximum(squares[:, None] + squares[None, :] - 2 * z @ z.T, 0)


def inverse_median(blocks: DataFrame) -> DataFrame:
    """gamma: one over the median, over blocks, of the median squared distance of a block's pairs (with one block: over the median of all pairs)."""

    def median(rows: pd.DataFrame) -> pd.DataFrame:
        d = _distances(rows)[np.triu_indices(len(rows), 1)]
        return pd.DataFrame({"median": [float(np.median(d))]}) if len(d) else pd.DataFrame({"median": pd.Series(dtype=float)})

    medians = blocks.groupBy("block").applyInPandas(median, "median double")
    return medians.agg((1 / F.greatest(F.percentile("median", F.lit(0.5)), F.lit(1e-12))).alias("gamma"))


def row_hash(vec_id: Column) -> Column:
    """32 bits of a row's hash, as a long."""
    return F.conv(F.substring(F.sha2(vec_id.cast("string"), 256), 1, 8), 16, 10).cast("long")


def mixed(hashes: np.ndarray, seed: int, replicate: int) -> np.ndarray:
    """32-bit hashes put in another order for each replicate: a key joins them and two rounds of shifts and products, each one to one, spread it."""
    x = hashes ^ np.uint32((seed * SEED_STEP + replicate * REPLICATE_STEP) % 2**32)
    for shift, factor in MIX:
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


def _kernel_sums(blocks: DataFrame, gamma: float | None, permutations: int, seed: int) -> DataFrame:
    """replicate (0: the sides as they are) with sums of the kernel and numbers of pairs, within x, within y and across, over all blocks."""

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id", "side"])
        k = np.exp(-rows["gamma"].iloc[0] * _distances(rows))
        side, hashes = rows["side"].to_numpy(), rows["h"].to_numpy().astype(np.uint32)
        y = np.ones((len(rows), permutations + 1))
        y[:, 0] = side
        for r in range(1, permutations + 1):
            y[np.argsort(mixed(hashes, seed, r), kind="stable")[: (side == 0).sum()], r] = 0
        x, own = 1 - y, np.diag(k)
        to_y, to_x = k @ y, k @ x
        nx, ny = x.sum(0), y.sum(0)
        values = [(x * to_x).sum(0) - own @ x, nx * (nx - 1), (y * to_y).sum(0) - own @ y, ny * (ny - 1), (x * to_y).sum(0), nx * ny]
        return pd.DataFrame({"replicate": np.arange(permutations + 1)} | dict(zip(_SUMS, values)))

    blocks = blocks.withColumn("h", row_hash(F.col("vec_id")))  # one hash a row serves all permutations
    with_gamma = blocks.withColumn("gamma", F.lit(float(gamma))) if gamma else blocks.crossJoin(F.broadcast(inverse_median(blocks)))  # one row
    found = with_gamma.groupBy("block").applyInPandas(sums, "replicate int, " + ", ".join(f"{c} double" for c in _SUMS))
    return found.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _discrepancy() -> Column:
    return F.try_divide("sxx", "nxx") + F.try_divide("syy", "nyy") - 2 * F.try_divide("sxy", "nxy")


def mmd2(x: DataFrame, y: DataFrame, gamma: float | None = None, block: int = BLOCK) -> DataFrame:
    """mmd2: the unbiased squared maximum mean discrepancy with the kernel exp(-gamma * d^2), gamma by the median heuristic if not given.

    All rows take part. Pairs are those within blocks, so the cost is linear in the rows and a task's memory is bounded; windows of
    at most `block` rows are one block, which gives the statistic over all pairs.
    """
    return _kernel_sums(in_blocks(x, y, block), gamma, 0, 0).agg(F.max(_discrepancy()).alias("mmd2"))


def mmd_test(x: DataFrame, y: DataFrame, permutations: int = 500, gamma: float | None = None, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """mmd2, p_value, null_mean, null_p95: the same with a permutation test; sides are permuted within blocks, by hashes of permutation and row."""
    stats = _kernel_sums(in_blocks(x, y, block), gamma, permutations, seed).select("replicate", _discrepancy().alias("v"))
    observed = F.max(F.when(F.col("replicate") == 0, F.col("v")))
    drawn = F.when(F.col("replicate") > 0, F.col("v"))
    out = stats.agg(observed.alias("mmd2"), F.avg(drawn).alias("null_mean"), F.percentile(drawn, F.lit(0.95)).alias("null_p95"), F.collect_list(drawn).alias("null"))  # one value a permutation
    beyond = F.size(F.filter("null", lambda v: v >= F.col("mmd2")))
    return out.select("mmd2", F.when(F.col("mmd2").isNotNull(), (1 + beyond) / (F.lit(permutations) + 1)).alias("p_value"), "null_mean", "null_p95")


def _moments(rows: DataFrame, dim: int) -> DataFrame:
    """side, chunk, t (third moments of the vectors with a one appended, in chunks), with the rows' number n and their sum of own kernels in chunk -1."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moments, own = {}, {}
        for batch in batches:
            for side, part in batch.groupby("side"):
                for lo in range(0, len(part), 1024):
                    a = np.array(part["e"].iloc[lo : lo + 1024].tolist(), dtype=np.float64)
                    if a.shape[1] != dim:
                        raise ValueError(f"vectors of {a.shape[1]} components instead of {dim}")
                    a = np.hstack([a / np.sqrt(dim), np.ones((len(a), 1))])
                    squares = (a[:, :, None] * a[:, None, :]).reshape(len(a), -1)
                    moments[side] = moments.get(side, 0) + squares.T @ a
                    own[side] = own.get(side, 0) + np.array([len(a), ((a * a).sum(1) ** 3).sum()])
        for side, m in moments.items():
            flat = m.ravel()
            chunks = [flat[lo : lo + CHUNK] for lo in range(0, len(flat), CHUNK)]
            yield pd.DataFrame({"side": side, "chunk": range(-1, len(chunks)), "t": [own[side], *chunks]})

    def total(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"side": part["side"].iloc[:1], "chunk": part["chunk"].iloc[:1], "t": [np.sum(np.stack(part["t"].tolist()), axis=0)]})

    schema = "side int, chunk int, t array<double>"
    return rows.select("side", "e").mapInPandas(partial, schema).groupBy("side", "chunk").applyInPandas(total, schema)


def kid(x: DataFrame, y: DataFrame, dim: int) -> DataFrame:
    """kid: the unbiased discrepancy with the cubic kernel (a . b / dim + 1)^3, over all pairs of both windows.

    The kernel is the inner product of third moments of (a / sqrt(dim), 1), so sums over all pairs are inner products of two sums over rows:
    no pairs are formed, and each task sends (dim + 1)^3 numbers a window.
    """
    m = _moments(_both(x, y), dim)
    side = lambda s: m.filter(F.col("side") == s).select("chunk", F.col("t").alias(f"t{s}"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = side(0).join(side(1), "chunk")
    body, head = F.col("chunk") >= 0, F.col("chunk") == -1
    sums = rows.agg(
        *[F.sum(F.when(body, dot(f"t{p}", f"t{q}"))).alias(f"k{p}{q}") for p, q in ((0, 0), (1, 1), (0, 1))],
        *[F.max(F.when(head, F.col(f"t{s}")[i])).alias(f"{c}{s}") for s in (0, 1) for i, c in enumerate(("n", "own"))],
    )
    own = [F.try_divide(F.col(f"k{s}{s}") - F.col(f"own{s}"), F.col(f"n{s}") * (F.col(f"n{s}") - 1)) for s in (0, 1)]
    return sums.select((own[0] + own[1] - 2 * F.try_divide("k01", F.col("n0") * F.col("n1"))).alias("kid"))


#: Subsets are the first rows in the order of (A^(2r+1) * hash + A^(2r+2)) modulo PRIME, so a row is hashed once for all of them.
PRIME, A = 2_147_483_647, 48_271


def subset_orders(subsets: int) -> list[tuple[int, int]]:
    return [(pow(A, 2 * r + 1, PRIME), pow(A, 2 * r + 2, PRIME)) for r in range(subsets)]


def kid_subsets(x: DataFrame, y: DataFrame, subsets: int = 50, size: int = 200) -> DataFrame:
    """kid and kid_std: mean and deviation, over subsets of `size` rows of each window, of the unbiased discrepancy with the cubic kernel (a . b / dim + 1)^3.

    With fewer rows in a window, subsets have as many of both. Subsets are drawn by hash; only rows that may belong to one leave the scan, some `size` a subset
    and window, so the cost beyond the scan does not grow with the windows.
    """
    rows = _both(x, y)
    counts = rows.agg(*[F.count_if(F.col("side") == s).alias(f"n{s}") for s in (0, 1)])  # one row
    counts = counts.withColumn("m", F.least(F.lit(size), "n0", "n1"))
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in subset_orders(subsets)])
    rows = rows.withColumn("h", row_hash(F.col("vec_id")) % PRIME).select("*", F.posexplode(pairs).alias("subset", "p")).withColumn("u", (F.col("h") * F.col("p.a") + F.col("p.b")) % PRIME)
    # six deviations beyond the expected number, so that no subset lacks rows
    share = (F.col("m") + 6 * F.sqrt("m") + 10) / F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))
    rows = rows.crossJoin(F.broadcast(counts)).filter(F.col("u") <= share * PRIME).select("subset", "side", "u", "vec_id", "e", "m")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        m = int(part["m"].iloc[0])
        part = part.sort_values(["u", "vec_id"])
        a, b = (np.array(part["e"][part["side"] == s].tolist()[:m], dtype=np.float64) for s in (0, 1))
        if min(len(a), len(b)) < 2:
            return pd.DataFrame({"v": pd.Series(dtype=float)})
        kernel = lambda p, q: (p @ q.T / p.shape[1] + 1) ** 3
        own = lambda p: (kernel(p, p).sum() - np.trace(kernel(p, p))) / (len(p) * (len(p) - 1))
        return pd.DataFrame({"v": [own(a) + own(b) - 2 * kernel(a, b).mean()]})

    return rows.groupBy("subset").applyInPandas(one, "v double").agg(F.avg("v").alias("kid"), F.stddev_pop("v").alias("kid_std"))
