"""The bootstrap of rank correlations against rows drawn and ranked one replicate at a time."""

import numpy as np
import pandas as pd

from tidemark.operators import research


def test_a_replicate_ranks_anew():
    rng = np.random.default_rng(1)
    for ties in (5, 1000):
        x, y = rng.integers(0, ties, 80), rng.integers(0, ties, 80)
        w = rng.multinomial(80, np.full(80, 1 / 80))
        rows = pd.DataFrame({"x": np.repeat(x, w), "y": np.repeat(y, w)})
        want = rows["x"].rank().corr(rows["y"].rank())
        (cx, cy) = (np.unique(v, return_inverse=True)[1] for v in (x, y))
        assert abs(research.ranked_corr(w, cx, cy) - want) < 1e-12
    assert np.isnan(research.ranked_corr(np.array([3, 0]), np.array([0, 1]), np.array([0, 1])))


def interval(x, y, replicates, seed):
    rng, out = np.random.default_rng(seed), []
    for _ in range(replicates):
        i = rng.integers(0, len(x), len(x))
        out.append(pd.Series(x[i]).rank().corr(pd.Series(y[i]).rank()))
    return np.quantile(out, [0.005, 0.995]), np.array(out)


def test_interval_is_that_of_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y, z = 0.3 * x + rng.normal(size=300), np.round(rng.normal(size=300))
    df = spark.createDataFrame([(float(a), float(c), float(b)) for a, b, c in zip(x, y, z, strict=True)] + [(None, None, 2.0), (1.0, float("nan"), None), (float("nan"), 1.0, None)], "x double, z double, y double").repartition(5)
    got = {r.feature: r for r in research.significances(df, ["x", "z"], "y", replicates=4000).collect()}
    for c, v in (("x", x), ("z", z)):
        want, every = interval(v, y, 2000, 3)
        assert got[c].n == 300
        assert abs(got[c].ic - pd.Series(v).rank().corr(pd.Series(y).rank())) < 1e-9
        # quantiles of 1% tails in 2,000 and 4,000 draws: a few hundredths at most
        assert np.abs(np.array([got[c].ci_low, got[c].ci_high]) - want).max() < 0.03
        assert abs(got[c].p_value - 2 * min((every <= 0).mean(), (every >= 0).mean())) < 0.05
    assert got["x"].significant and not got["z"].significant


def test_cells_change_little(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=3000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, 0.2 * x + rng.normal(size=3000), strict=True)], "x double, y double")
    fine, rough = (research.significances(df, ["x"], "y", replicates=1000, cells=k).first() for k in (4096, 128))
    assert abs(fine.ic - rough.ic) < 1e-12 and abs(fine.ci_low - rough.ci_low) < 0.01 and abs(fine.ci_high - rough.ci_high) < 0.01
    assert research.significances(df.limit(20), ["x"], "y").count() == 0
