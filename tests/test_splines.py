"""Splines against a dense system of scalar B-splines, whole and in slices."""

import numpy as np
import pytest

from tidemark.functions import splines
from tidemark.functions.panel import Panel
from tidemark.operators import clean

P = Panel(("k",), ("t",))


def knots(x, k):
    inner = list(x[(k + 1) // 2 : len(x) - (k + 1) // 2]) if k % 2 else [(a + b) / 2 for a, b in zip(x[:-1], x[1:])][k // 2 : len(x) - 1 - k // 2]
    return [x[0]] * (k + 1) + inner + [x[-1]] * (k + 1)


def b_spline(t, i, k, u, last):
    """By the recursion, one value at a time."""
    if k == 0:
        return float(t[i] <= u < t[i + 1] or u == last and t[i] < t[i + 1] == last)
    a = (u - t[i]) / (t[i + k] - t[i]) * b_spline(t, i, k - 1, u, last) if t[i + k] > t[i] else 0.0
    b = (t[i + k + 1] - u) / (t[i + k + 1] - t[i + 1]) * b_spline(t, i + 1, k - 1, u, last) if t[i + k + 1] > t[i + 1] else 0.0
    return a + b


def dense(x, y, u, degree):
    k = min(degree, len(x) - 1)
    if k == 0:
        return np.full(len(u), y[0])
    t = knots(x, k)
    assert len(t) == len(x) + k + 1
    row = lambda v: [b_spline(t, i, k, v, x[-1]) for i in range(len(x))]
    c = np.linalg.solve(np.array([row(v) for v in x]), y)
    return np.array([y[0] if v <= x[0] else y[-1] if v >= x[-1] else float(np.dot(row(v), c)) for v in u])


@pytest.mark.parametrize("degree", [1, 2, 3, 4, 5])
def test_equals_a_dense_solve(degree):
    rng = np.random.default_rng(degree)
    for n in (1, 2, 3, 4, 6, 7, 40, 150):  # the last two are several blocks
        x = np.cumsum(rng.integers(1, 9, n)).astype(float)
        y = rng.normal(size=n)
        u = np.concatenate([x, rng.uniform(x[0] - 3, x[-1] + 3, 30)])
        assert np.allclose(splines.spline(x, y, u, degree), dense(x, y, u, degree), rtol=0, atol=1e-8), n


def test_polynomials_are_met_and_degrees_differ():
    x, u = np.array([0.0, 1, 4, 5, 9, 11, 12, 20]), np.linspace(0, 20, 50)
    for degree in (2, 3):
        f = np.polynomial.Polynomial(np.arange(1.0, degree + 2))
        assert np.allclose(splines.spline(x, f(x), u, degree), f(u), rtol=1e-9)
    y = np.sin(x)
    assert np.abs(splines.spline(x, y, u, 2) - splines.spline(x, y, u, 3)).max() > 0.01


def series(seed=3):
    rng, rows = np.random.default_rng(seed), []
    for k, n in (("a", 2500), ("b", 60), ("c", 5), ("d", 3), (None, 400)):
        x = np.cumsum(rng.normal(size=n))
        gap = rng.random(n) < 0.3
        if n == 2500:
            gap[:7] = gap[-9:] = gap[700:790] = True
        if n == 3:
            gap[:] = True
        rows += [(k, 2 * i, None if gap[i] else float(x[i]), None if i % 3 else float(i), "z") for i in range(n)]
    return rows


def test_filled_whole_and_in_slices(spark):
    rows = series()
    df = spark.createDataFrame(rows, "k string, t long, x double, w double, z string").repartition(3)
    for degree in (2, 3):
        whole = {(r.k, r.t): r for r in splines.spline_filled(df, P, ["x", "w"], degree).collect()}
        parts = {(r.k, r.t): r for r in splines.spline_filled(df, P, ["x", "w"], degree, rows=300).collect()}
        assert len(whole) == len(parts) == len(rows)
        for k in ("a", "b", "c", "d", None):
            own = [r for r in rows if r[0] == k]
            known = [(i, r[2]) for i, r in enumerate(own) if r[2] is not None]
            for i, r in enumerate(own):
                a, b = whole[(k, r[1])], parts[(k, r[1])]
                assert (a.x is None) == (b.x is None) == (not known) and a.z == "z"
                assert a.x is None or abs(a.x - b.x) < 1e-9, (k, i)
                assert abs(a.w - b.w) < 1e-9 and (r[3] is None or a.w == r[3])
            if k in ("b", "c"):
                x, y = (np.array(v, float) for v in zip(*known, strict=True))
                assert np.allclose([whole[(k, r[1])].x for r in own], [r[2] if r[2] is not None else v for r, v in zip(own, dense(x, y, np.arange(len(own)), degree), strict=True)], atol=1e-8)


def test_polynomial_and_spline_imputation(spark):
    df = spark.createDataFrame(series(4), "k string, t long, x double, w double, z string").where("k = 'b'")
    got = [{r.t: r.x for r in clean.interpolation_imputed(df, P, ["x"], how, 2).collect()} for how in ("polynomial", "spline")]
    assert None not in got[0].values() and max(abs(got[0][t] - got[1][t]) for t in got[0]) > 1e-3
    assert clean.interpolation_imputed(df.limit(0), P, ["x"], "spline").count() == 0
