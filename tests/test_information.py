"""Neighbour-based mutual information against a quadratic version."""

import math

import numpy as np
import pytest

from tablecraft.learn.information import neighbour_information
from tablecraft.learn.select import best_by_information


def psi(n):
    """Digamma of a whole number by its sum."""
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def by_force(x, y, k=3):
    sizes = {c: int((y == c).sum()) for c in set(y)}
    kept = np.array([sizes[c] > 1 for c in y])
    x, y = x[kept], y[kept]
    total = 0.0
    for v, c in zip(x, y):
        far = np.abs(x - v)
        mine = np.sort(far[y == c])  # itself first
        rank = min(k, sizes[c] - 1)
        if mine[rank] == 0:
            near, inside = (mine == 0).sum(), (far == 0).sum()
        else:
            near, inside = rank, (far < mine[rank] - (abs(v) + mine[rank]) * 1e-15).sum()
        total += psi(near) - psi(sizes[c]) - psi(inside)
    return max(0.0, psi(len(x)) + total / len(x)) if len(x) else 0.0


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(9)
    n = 2000
    y = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1])
    shift = np.array([{"a": 0.0, "b": 2.0, "c": -1.0}[c] for c in y])
    y[0] = "alone"
    return y, {
        "apart": rng.normal(size=n) + shift, "noise": rng.normal(size=n), "few": np.round(rng.normal(size=n) + shift), "some": np.round(rng.normal(size=n) + shift, 2),
        "one": np.ones(n),
    }


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 300])
def test_equals_brute_force(spark, table, rows_per_bucket):
    y, x = table
    names = list(x)
    df = spark.createDataFrame([(str(c), *map(float, v)) for c, *v in zip(y, *x.values())], "y string, " + ", ".join(f"{c} double" for c in names))
    got = {r.feature: r.mi for r in neighbour_information(df, names, "y", rows_per_bucket=rows_per_bucket).collect()}
    for c in names:
        assert math.isclose(got[c], by_force(x[c], y), abs_tol=1e-9), c
    assert got["apart"] > 0.2 > got["noise"] and got["one"] == pytest.approx(0, abs=1e-9)
    if rows_per_bucket > 1000:
        assert [r.feature for r in best_by_information(df, names, "y", 2).collect()] == sorted(names, key=lambda c: -by_force(x[c], y))[:2]


def test_nulls_single_classes_and_empty(spark):
    rows = [("a", 1.0), ("a", None), ("a", math.inf), (None, 1.0), ("b", math.nan), ("b", 2.0), ("a", 3.0)]
    df = spark.createDataFrame(rows, "y string, x double")
    # of x only the two rows of class a are left
    assert [(r.feature, r.mi) for r in neighbour_information(df, ["x"], "y").collect()] == [("x", pytest.approx(by_force(np.array([1.0, 3.0]), np.array(["a", "a"]))))]
    assert [tuple(r) for r in neighbour_information(df.limit(0), ["x"], "y").collect()] == [("x", 0.0)]
