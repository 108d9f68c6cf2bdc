"""Principal components, density clusters and the domain classifier against plain numpy."""

import numpy as np
import pytest

from sightline.operators import density, domain, reduction

SCHEMA = "vec_id long, embedding array<double>, label int, e string"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [float(c) for c in v], 7, "x") for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def blobs(seed, sizes, dim, spread=0.3, noise=0):
    r = np.random.default_rng(seed)
    parts = [r.normal(3 * r.normal(size=dim), spread, (n, dim)) for n in sizes]
    return r.permutation(np.vstack([*parts, r.uniform(-8, 8, (noise, dim))]))


def plain_hdbscan(x, least, samples):
    """Edges of a complete graph in order, then the tree of clusters top down."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(samples, n) - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    group, tree = {k: [k] for k in range(n)}, []
    of = list(range(n))
    for i, j in sorted(((i, j) for i in range(n) for j in range(i + 1, n)), key=lambda p: (w[p], p)):
        if of[i] != of[j]:
            tree.append((w[i, j], i, j))
            old, new = of[j], of[i]
            for k in group.pop(old):
                of[k] = new
                group[new].append(k)
    found = {}

    def parts(points, edges):
        at = {p: {p} for p in points}
        for _, i, j in edges:
            if at[i] is not at[j]:
                at[i] |= at[j]
                for k in at[j]:
                    at[k] = at[i]
        return list({id(s): s for s in at.values()}.values())

    def walk(points, edges, birth, name):
        """Splits off the longest edge after the other; returns the value and the chosen clusters below."""
        inverse, own, points = lambda v: 1 / max(v, 1e-150), 0.0, set(points)
        born = points
        while edges:
            last, *rest = sorted(edges, reverse=True)
            two = sorted(parts(points, rest), key=len)
            level = inverse(last[0])
            big = [s for s in two if len(s) >= least]
            if len(big) == 2:
                own += len(points) * (level - birth)
                below = [walk(s, [e for e in rest if e[1] in s], level, f"{name}{k}") for k, s in enumerate(big)]
                under = sum(v for v, _ in below)
                if name and not under > own:
                    return own, [born]
                return max(own, under), [c for _, cs in below for c in cs]
            gone = points if not big else points - big[0]
            own += len(gone) * (level - birth)
            if not big:
                return own, [born] if name else []
            points, edges = big[0], [e for e in rest if e[1] in big[0]]
        return own, [born] if name else []

    _, chosen = walk(range(n), tree, 0.0, "")
    label = np.full(n, -1)
    for k, members in enumerate(sorted(chosen, key=min)):
        label[list(members)] = k
    return label.tolist()


@pytest.mark.parametrize("seed,sizes,noise,least,samples,tile,per_range", [(1, [40, 30, 25], 20, 10, 5, 1024, 10**6), (2, [30, 30, 12], 30, 8, 3, 40, 25), (3, [60], 15, 15, 10, 50, 10**6)])
def test_clusters_agree_with_a_plain_walk(spark, seed, sizes, noise, least, samples, tile, per_range):
    x = blobs(seed, sizes, 3, noise=noise)
    got = density.hdbscan(frame(spark, x), least, samples, tile=tile, per_range=per_range)
    labels = [r.label for r in got.orderBy("vec_id").collect()]
    assert labels == plain_hdbscan(x, least, samples)
    assert len(sizes) == 1 or max(labels) >= 1


def test_rounds_compare_few_rows_again_and_each_nearest_row_is_found(spark, monkeypatch):
    r = np.random.default_rng(9)
    x = np.vstack([blobs(9, [90, 60], 3, noise=40), r.normal(size=(1, 3)).repeat(45, axis=0)])  # more copies than rows that are kept
    searched, search = [], density._searched
    monkeypatch.setattr(density, "KEPT", 8)
    monkeypatch.setattr(density, "PART", (16, 32))
    monkeypatch.setattr(density, "_searched", lambda some, n, *rest: searched.append(n) or search(some, n, *rest))
    rows = frame(spark, x).selectExpr("vec_id as node", "embedding as e")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for q in density._nearest(rows, len(x), 3, 8, 50).collect():
        assert [(n.d, n.node) for n in q.near] == sorted(zip(d[q.node].tolist(), range(len(x))))[:8]
    got = sorted((e.w, e.a, e.b) for e in density._spanning_tree(rows, len(x), 3, 5, 30).collect())
    core = np.sort(d, axis=1)[:, 4]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    of, want = list(range(len(x))), []
    for e in sorted((float(w[i, j]), i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        a, b = of[e[1]], of[e[2]]
        if a != b:
            want.append(e)
            of = [a if k == b else k for k in of]
    assert got == want
    assert searched and sum(searched) < 2 * len(x)


def test_small_and_odd_tables_of_vectors(spark):
    x = blobs(4, [6], 2)
    assert {r.label for r in density.hdbscan(frame(spark, x), 7, 2).collect()} == {-1}
    assert density.hdbscan(frame(spark, []), 5, 2).count() == 0
    odd = [*x, None, [], [float("nan"), 1], x[0], x[0]]
    got = density.hdbscan(frame(spark, odd), 3, 2).collect()
    assert sorted(r.vec_id for r in got) == [*range(6), 9, 10]
    with pytest.raises(Exception, match="components"):
        density.hdbscan(frame(spark, [[1.0], [1.0, 2.0]]), 2, 1)


def test_principal_components_agree_with_numpy(spark):
    x = blobs(5, [40, 30], 6) @ np.diag([5, 4, 3, 2, 1, 0.5])
    got = np.array([r.z for r in reduction.pca(frame(spark, x), 3).orderBy("vec_id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    assert np.allclose(got, ((x - x.mean(axis=0)) @ (vt * sign[:, None])[:3].T), atol=1e-9)
    assert reduction.pca(frame(spark, x[:4]), 8).orderBy("vec_id").first().z == pytest.approx([*x[0], 0, 0])
    assert reduction.pca(frame(spark, []), 2).count() == 0 and len(reduction.pca(frame(spark, x), 9).first().z) == 6


def plain_fit(x, t):
    w = np.zeros(x.shape[1] + 1)
    a, ridge = np.hstack([x, np.ones((len(x), 1))]), np.diag([1.0] * x.shape[1] + [0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - t) + ridge @ w)
    return w


def test_the_domain_classifier_agrees_with_numpy(spark):
    r = np.random.default_rng(6)
    x, y = r.normal(size=(90, 4)), r.normal(0.5, 1, (60, 4))
    dx, dy = frame(spark, x), frame(spark, y, 1000)
    rows = domain._folded(dx, dy, 5).collect()
    a, t, fold = np.array([q.e for q in rows]), np.array([q.side for q in rows]), np.array([q.fold for q in rows])
    areas = []
    for f in range(5):
        w = plain_fit(a[fold != f], t[fold != f])
        s, o = a[fold == f] @ w[:-1] + w[-1], t[fold == f]
        areas.append(np.mean([(p > q) + (p == q) / 2 for p in s[o == 1] for q in s[o == 0]]))
    assert domain.domain_auc(dx, dy).first().domain_auc == pytest.approx(np.mean(areas), abs=1e-6)
    assert domain.domain_auc(dx, frame(spark, y[:1])).first().domain_auc is None


def test_areas_count_ties_half(spark):
    rows = [(s, f, v) for f in (0, 1) for s, v in ((1, 0.0), (1, 2.0), (0, 0.0), (0, 0.0), (0, -700.0), (1, 900.0))] + [(1, 2, 0.5)]
    got = {r.fold: r.auc for r in domain.auc(spark.createDataFrame(rows, "side int, fold int, score double")).collect()}
    assert got == {0: pytest.approx(8 / 9), 1: pytest.approx(8 / 9), 2: None}


def test_the_report_decides_by_the_test_alone(spark):
    r = np.random.default_rng(8)
    x, y = r.normal(size=(60, 4)), r.normal(1.0, 1, (50, 4))
    b = lambda lo, n: spark.createDataFrame([(float(v),) for v in r.uniform(lo, lo + 0.2, n)], "bright double")
    one = domain.drift_report(frame(spark, x), frame(spark, y, 500), (b(0.4, 80), b(0.1, 60)), "bright", 200).first()
    assert one.drift and one.p_value < 0.01 and one.domain_auc > 0.7 and one.psi_brightness > 1 and (one.n_reference, one.n_current) == (60, 50)
    assert one.brightness_ref_mean > one.brightness_cur_mean
    same = domain.drift_report(frame(spark, x[:30]), frame(spark, x[30:], 500), (b(0.4, 80), b(0.1, 60)), "bright", 200).first()
    assert not same.drift and same.psi_brightness > 1
