"""How well a classifier tells two windows of vectors apart, and the drift report.

The classifier is a logistic regression with a penalty of half the squared weights, fitted by Newton steps whose gradients and second derivatives are
summed inside tasks, for all folds at once. Areas under the curve are counted from ranks, by score bins, so no task orders a whole fold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.hashing import prefix
from sightline.functions.vectors import clean, matrix, summed, width
from sightline.operators import decisions, drift

FOLDS, PENALTY = 5, 1.0
#: Newton steps at most, and the largest change of a weight at which they end.
STEPS, CLOSE = 50, 1e-10
#: Bins of scores in which ranks are counted.
BINS = 1024
ALPHA = 0.01


def _folded(x: DataFrame, y: DataFrame, folds: int) -> DataFrame:
    """side, vec_id, e, fold: each side is dealt to folds by hash."""
    fold = F.pmod(F.conv(F.substring(prefix(F.col("vec_id")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    sides = [clean(t).select(F.lit(s).alias("side"), "vec_id", "e", fold.alias("fold")) for s, t in enumerate((x, y))]
    return sides[0].unionByName(sides[1])


def fit(rows: DataFrame, dim: int, folds: int, penalty: float = PENALTY) -> np.ndarray:
    """A row of weights (the last is the intercept, which is not penalized) for each fold, fitted to the rows of all others."""
    w, m = np.zeros((folds, dim + 1)), dim + 1
    ridge = np.diag(np.append(np.full(dim, 1 / penalty), 0.0))
    data = rows.select("e", "side", "fold")
    for _ in range(STEPS):

        def part(batch: pa.RecordBatch, w=w) -> np.ndarray:
            out = np.zeros((folds, m + m * m))
            if batch.num_rows:
                x = np.hstack([matrix(batch.column(0)), np.ones((batch.num_rows, 1))])
                y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for f in range(folds):
                    a, t = x[fold != f], y[fold != f]
                    p = 1 / (1 + np.exp(-np.clip(a @ w[f], -500, 500)))
                    out[f, :m], out[f, m:] = a.T @ (p - t), ((a * (p * (1 - p))[:, None]).T @ a).reshape(-1)
            return out

        found = summed(data, part, folds * (m + m * m)).reshape(folds, -1)
        step = np.stack([np.linalg.solve(g[m:].reshape(m, m) + ridge + 1e-12 * np.eye(m), g[:m] + ridge @ w[f]) for f, g in enumerate(found)])
        w = w - step
        if np.abs(step).max() < CLOSE:
            break
    return w


def scored(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """side, fold, score of each row by the weights of its own fold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                fold = batch.column(2).to_numpy()
                score = (matrix(batch.column(0)) * w[fold, :-1]).sum(axis=1) + w[fold, -1]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(score)], names=["side", "fold", "score"])

    return rows.select("e", "side", "fold").mapInArrow(run, "side int, fold int, score double")


def auc(scores: DataFrame) -> DataFrame:
    """fold and auc: the share of pairs (row of side 1, row of side 0) in which the first scores higher; equal scores count half. Null without pairs."""
    equal = scores.groupBy("fold", "score").agg(F.sum("side").alias("ones"), F.count_if(F.col("side") == 0).alias("zeros"))
    # bins of equal width of the logistic of the score, which keeps their order; zeros of lower bins, then of lower scores in the bin
    equal = equal.withColumn("bin", F.floor(F.lit(BINS) / (1 + F.exp(-F.col("score")))))
    bins = equal.groupBy("fold", "bin").agg(F.sum("zeros").alias("z"))
    below = bins.withColumn("below", F.sum("z").over(Window.partitionBy("fold").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))).drop("z")  # at most BINS rows a fold
    inside = F.sum("zeros").over(Window.partitionBy("fold", "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    placed = equal.withColumn("inside", inside).join(below, ["fold", "bin"])
    won = F.col("ones") * (F.coalesce("below", F.lit(0)) + F.coalesce("inside", F.lit(0)) + F.col("zeros") / 2)
    return placed.groupBy("fold").agg(F.try_divide(F.sum(won), F.sum("ones") * F.sum("zeros")).alias("auc"))


def domain_auc(x: DataFrame, y: DataFrame, folds: int = FOLDS, penalty: float = PENALTY) -> DataFrame:
    """domain_auc: the mean, over folds, of the area under the curve on rows that the fold's classifier has not seen.

    There are as many folds as the smaller window has rows, at most `folds`; with fewer than two, or no fold with rows of both windows, it is null.
    """
    sizes = [clean(t).count() for t in (x, y)]
    folds = min(folds, *sizes)
    if folds < 2:
        return x.sparkSession.range(1).select(F.lit(None).cast("double").alias("domain_auc"))
    rows = _folded(x, y, folds)
    w = fit(rows, width(rows), folds, penalty)
    return auc(scored(rows, w)).agg(F.avg("auc").alias("domain_auc"))


def drift_report(x: DataFrame, y: DataFrame, brightness: tuple[DataFrame, DataFrame], column: str, permutations: int = 500, alpha: float = ALPHA) -> DataFrame:
    """One row: the discrepancy of the windows with its test, the classifier's area, the stability index of a tabular column with its means, and the verdict.

    Drift is decided by the permutation test alone (p_value below alpha); the other figures say how far and where.
    """
    one = [drift.mmd_test(x, y, permutations), domain_auc(x, y), decisions.psi(*brightness, column).withColumnRenamed("psi", "psi_brightness")]
    one += [clean(t).agg(F.count(F.lit(1)).alias(f"n_{n}")) for n, t in (("reference", x), ("current", y))]
    one += [t.agg(F.avg(column).alias(f"brightness_{n}_mean")) for n, t in (("ref", brightness[0]), ("cur", brightness[1]))]
    out = one[0]
    for t in one[1:]:
        out = out.crossJoin(F.broadcast(t))  # one row each
    return out.withColumns({"alpha": F.lit(alpha), "drift": F.coalesce(F.col("p_value") < alpha, F.lit(False))})
