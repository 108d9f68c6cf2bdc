"""The distances between windows of vectors, against plain numpy over all pairs."""

import numpy as np
import pytest

from sightline.operators import drift

SCHEMA = "vec_id long, embedding array<float>, note string"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [float(c) for c in v], "n") for i, v in enumerate(vectors)], SCHEMA)


def kernel_distance(x, y, kernel):
    own = lambda a: (kernel(a, a).sum() - np.trace(kernel(a, a))) / (len(a) * (len(a) - 1))
    return own(x) + own(y) - 2 * kernel(x, y).mean()


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(60, 4)).astype(np.float32), rng.normal(0.6, 1, size=(40, 4)).astype(np.float32)
    y[:3] = y[3]  # repeated rows
    return x.astype(float), y.astype(float), frame(spark, x), frame(spark, y, 1000)


def test_one_block_is_the_statistic_over_all_pairs(windows):
    x, y, dx, dy = windows
    z = np.vstack([x, y])
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    gamma = 1 / np.median(d[np.triu_indices(len(z), 1)])
    rbf = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2))
    assert drift.mmd2(dx, dy).first().mmd2 == pytest.approx(kernel_distance(x, y, rbf), abs=1e-9)
    cubic = lambda a, b: (a @ b.T / 4 + 1) ** 3
    assert drift.kid(dx.repartition(5), dy, 4).first().kid == pytest.approx(kernel_distance(x, y, cubic), abs=1e-9)


def test_blocks_hold_every_row_once(windows):
    x, y, dx, dy = windows
    rows = drift.in_blocks(dx, dy, 16).collect()
    assert len(rows) == 100 and {r.block for r in rows} == set(range(4))
    rbf = lambda a, b: np.exp(-0.3 * ((a[:, None] - b[None]) ** 2).sum(2))
    sums = np.zeros(6)
    for block in range(4):
        a, b = (np.array([r.e for r in rows if r.block == block and r.side == s]) for s in (0, 1))
        for k, t in enumerate((a, b)):
            sums[2 * k] += rbf(t, t).sum() - len(t)
            sums[2 * k + 1] += len(t) * (len(t) - 1)
        sums[4:] += rbf(a, b).sum(), len(a) * len(b)
    want = sums[0] / sums[1] + sums[2] / sums[3] - 2 * sums[4] / sums[5]
    assert drift.mmd2(dx, dy, 0.3, 16).first().mmd2 == pytest.approx(want, abs=1e-9)


def test_permutations_tell_drift_from_none(spark, windows):
    x, _, dx, dy = windows
    drifted = drift.mmd_test(dx, dy, 200).first()
    assert drifted.p_value < 0.01 and drifted.mmd2 > drifted.null_p95
    halves = drift.mmd_test(frame(spark, x[:30]), frame(spark, x[30:], 1000), 200).first()
    assert halves.p_value > 0.01 and abs(halves.null_mean) < 0.02


def test_permutations_are_those_of_the_mixed_hashes(spark, windows):
    import hashlib

    x, y, dx, dy = windows
    ids, z = [*range(60), *range(1000, 1040)], np.vstack([x, y])
    hashes = np.array([int(hashlib.sha256(str(i).encode()).hexdigest()[:8], 16) for i in ids], np.uint32)
    rbf = lambda a, b: np.exp(-0.3 * ((a[:, None] - b[None]) ** 2).sum(2))
    null = []
    for r in range(1, 41):
        order = np.argsort(drift.mixed(hashes, 5, r), kind="stable")
        null.append(kernel_distance(z[order[:60]], z[order[60:]], rbf))
    got = drift.mmd_test(dx, dy, 40, 0.3, seed=5).first()
    observed = kernel_distance(x, y, rbf)
    assert (got.mmd2, got.null_mean, got.null_p95) == (pytest.approx(observed, abs=1e-9), pytest.approx(np.mean(null), abs=1e-9), pytest.approx(np.quantile(null, 0.95), abs=1e-9))
    assert got.p_value == pytest.approx((1 + sum(v >= observed for v in null)) / 41)


def test_mixed_orders_are_like_drawn_ones():
    hashes = np.random.default_rng(1).integers(0, 2**32, 200, dtype=np.uint32)
    places = np.array([np.argsort(np.argsort(drift.mixed(hashes, 0, r))) for r in range(1, 501)])
    # places of a row over permutations are even, and those of one permutation do not follow the next one's
    assert abs(places.mean(0) - 99.5).max() < 15 and len(np.unique(places, axis=0)) == 500
    assert max(abs(np.corrcoef(places[r], places[r + 1])[0, 1]) for r in range(499)) < 0.3
    assert len(set(drift.mixed(np.arange(100_000, dtype=np.uint32), 3, 9).tolist())) == 100_000


def test_edge_cases(spark, windows):
    x, _, dx, dy = windows
    none = frame(spark, [])
    assert drift.mmd2(none, dy).first().mmd2 is None and drift.kid(dx, none, 4).first().kid is None
    assert drift.mmd_test(none, none, 5).first().p_value is None
    assert drift.mmd2(frame(spark, x[:1]), dy).first().mmd2 is None
    dirty = dx.unionByName(frame(spark, [None, [float("nan")] * 4, [float("inf"), 0, 0, 0]], 500))
    assert drift.kid(dirty, dy, 4).first().kid == pytest.approx(drift.kid(dx, dy, 4).first().kid, abs=1e-12)
