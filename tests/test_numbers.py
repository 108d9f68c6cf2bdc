"""Exact quantiles against numpy, and fixed-point text against printf."""

import numpy as np
import pytest

from sightline.functions.decimals import fixed
from sightline.functions.quantiles import quantiles
from sightline.operators import decisions

SHARES = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)


def test_quantiles_of_groups_equal_numpy(spark):
    r = np.random.default_rng(5)
    held = {"hot": r.integers(0, 40, 3000).astype(float), "smooth": r.normal(size=501), "one": np.array([7.5]), "two": np.array([1.0, 2.0]), None: np.array([3.0, 4.0, 8.0])}
    rows = [(k, float(x)) for k, v in held.items() for x in v] + [("hot", None), ("empty", None)]
    got = {q.k: q.quantiles for q in quantiles(spark.createDataFrame(rows, "k string, x double").repartition(7), ["k"], "x", SHARES).collect()}
    assert set(got) == set(held)
    for k, v in held.items():
        assert got[k] == pytest.approx(np.quantile(v, SHARES), abs=1e-12)
    assert quantiles(spark.createDataFrame([], "x double"), [], "x", SHARES).count() == 0
    whole = quantiles(spark.createDataFrame(rows, "k string, x double"), [], "x", (0.5,)).first()
    assert whole.quantiles == pytest.approx([np.median(np.concatenate(list(held.values())))])


def test_latency_keeps_groups_of_nulls(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)]
    got = {r.k: (r.p50, r["mean"], r.runs) for r in decisions.latency(spark.createDataFrame(rows, "k string, x double"), "k", "x").collect()}
    assert got == {"a": (2.0, 2.0, 2), "b": (None, None, 1), None: (5.0, 5.0, 1)}


def test_psi_of_flat_and_empty_columns(spark):
    table = lambda *x: spark.createDataFrame([(v,) for v in x], "x double")
    assert decisions.psi(table(1.0, 1.0, 1.0), table(2.0), "x").first().psi == 0
    assert decisions.psi(table(), table(2.0), "x").first().psi is None


@pytest.mark.parametrize("decimals", [1, 3, 6])
def test_fixed_text_equals_printf(spark, decimals):
    r = np.random.default_rng(decimals)
    ties = [(2 * k + 1) / 128 for k in range(64)] + [k + 0.5 for k in range(8)] + [0.25, 0.75, 0.125, 2.5, 0.35, 0.45]
    near = [float(f"0.{k:06d}5") for k in r.integers(0, 10**6, 400)]  # decimal halves that no double holds
    odd = [0.0, -0.0, -1e-9, -0.5, 1e-300, 5e-324, 999999.9999995, 123456789.0000005, -0.0078125, 1 / 3]
    values = [float(v) for v in [*ties, *near, *odd, *r.random(400), *(r.random(200) * 1e5)]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", fixed(df.x, decimals).alias("t")).collect():
        assert row.t == f"{row.x:.{decimals}f}", row.x
