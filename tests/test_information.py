"""Mutual information by neighbours against all distances."""

import math

import numpy as np
import pytest

from tidemark.operators import information
from tidemark.operators.information import digamma, neighbour_information


def brute(x, y, k=3):
    x, y = (v / (v.std() or 1.0) for v in (np.asarray(x, float), np.asarray(y, float)))
    n = len(x)
    dx, dy = (np.abs(v[:, None] - v[None, :]) for v in (x, y))
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1]
    m = [np.where(r > 0, (e < (r * (1 - 1e-9))[:, None]).sum(axis=1), (e == 0).sum(axis=1)) for e in (dx, dy)]
    psi = np.array([-0.5772156649015329 + sum(1 / i for i in range(1, v)) for v in range(1, n + 1)])
    return max(0.0, psi[n - 1] + psi[k - 1] - psi[m[0] - 1].mean() - psi[m[1] - 1].mean())


def test_digamma():
    assert np.allclose(digamma(np.array([1, 2, 10, 1000])), [-0.5772156649015329, 0.42278433509846714, 2.2517525890667211, 6.907255195648812], atol=1e-13)


def made(n=2000, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n)
    a, b, c, d = y + rng.normal(size=n), rng.normal(size=n), np.round(y * 2), np.where(rng.random(n) < 0.4, 0.5, rng.exponential(size=n))
    y[: n // 3][d[: n // 3] == 0.5] = 1.25  # hot pairs
    return np.stack([a, b, c, d, np.full(n, 7.0), y], axis=1)


@pytest.mark.parametrize("cell,rows", [(20_000, 1_000_000), (90, 150)])
def test_equals_brute_force(spark, cell, rows):
    data = made()
    df = spark.createDataFrame([tuple(map(float, r)) for r in data] + [(None, 1.0, float("nan"), 1.0, 7.0, None), (None, 1.0, 1.0, float("inf"), None, float("nan"))], "a double, b double, c double, d double, e double, y double").repartition(4)
    got = {r.feature: (r.n, r.mi) for r in neighbour_information(df, ["a", "b", "c", "d", "e"], "y", cell=cell, rows=rows).collect()}
    want = {c: brute(data[:, i], data[:, -1]) for i, c in enumerate("abcde")}
    assert set(got) == set("abcde") and want["a"] > 0.2 > want["b"]
    for c, v in want.items():
        assert got[c][0] == 2000 and math.isclose(got[c][1], v, abs_tol=1e-9), (c, got[c], v)


def test_few_rows(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(5)], "a double, y double")
    assert neighbour_information(df.limit(0), ["a"], "y").collect() == []
    assert [tuple(r) for r in neighbour_information(df.where("a < 3"), ["a"], "y").collect()] == [("a", 3, None)]
    got = neighbour_information(df, ["a"], "y").collect()
    assert math.isclose(got[0].mi, brute(np.arange(5), np.arange(5) ** 2), abs_tol=1e-9)


def test_nearest_against_all_distances():
    rng = np.random.default_rng(5)
    x, y = np.sort(rng.normal(size=300)), rng.normal(size=300)
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(information.nearest(x, y, x, y, 4)[0], np.sort(d, axis=1)[:, :4])
