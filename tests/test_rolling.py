"""Order statistics of the last n rows against plain loops."""

import time

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import rolling
from tidemark.functions.panel import Panel
from tidemark.functions.slices import in_slices

P = Panel(("k",), ("t",))


def made(ties, seed=1):
    rng, rows = np.random.default_rng(seed), []
    for k, n in (("a", 700), ("b", 33), ("c", 1), (None, 90), ("d", 12)):
        x = rng.integers(0, 8, n).astype(float) if ties else rng.normal(size=n)
        y = np.round(x + rng.normal(size=n), 0 if ties else 9)
        for i in range(n):
            rows.append((k, i, None if rng.random() < 0.03 else float(x[i]), None if rng.random() < 0.03 else float(y[i]), float(rng.normal() * 0.02) if i % 50 else -0.4))
    return pd.DataFrame(rows, columns=["k", "t", "x", "y", "r"])


@pytest.fixture(scope="module", params=[False, True])
def panel(spark, request):
    pdf = made(request.param)
    rows = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "k string, t long, x double, y double, r double").repartition(4)


def check(pdf, df, column, want):
    got = {(r.k, r.t): r[column] for r in df.collect()}
    assert len(got) == len(pdf)
    for k, part in pdf.groupby(pdf.k.fillna("~")):
        part = part.sort_values("t")
        for i, t in enumerate(part.t):
            a, b = got[(None if k == "~" else k, t)], want(part, i)
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (k, t, a, b)


def window(part, c, i, n):
    x = part[c].to_numpy(float)[max(0, i - n + 1) : i + 1]
    return None if len(x) < n or np.isnan(x).any() else x


def test_rank_quantile_and_drawdown(panel):
    pdf, df = panel
    for n in (1, 5, 20):
        rank = lambda part, i, n=n: None if (w := window(part, "x", i, n)) is None else ((w < w[-1]).sum() + ((w == w[-1]).sum() + 1) / 2) / n
        check(pdf, rolling.rank_pct(df, P, {"o": "x"}, n), "o", rank)
        cut = lambda part, i, n=n: None if (w := window(part, "y", i, n)) is None else float(np.quantile(w, 0.3))
        check(pdf, rolling.quantiles(df, P, {"o": ("y", 0.3)}, n), "o", cut)

        def fall(part, i, n=n):
            w = window(part, "r", i, n)
            if w is None:
                return None
            c = np.cumprod(1 + w)
            return float((c / np.maximum.accumulate(c) - 1).min())

        check(pdf, rolling.rolling_drawdown(df, P, "r", n, "o"), "o", fall)


def test_rank_correlation(panel):
    pdf, df = panel
    for n, least in ((12, 9.6), (40, 30), (3, 2)):

        def corr(part, i, n=n, least=least):
            both = part.iloc[max(0, i - n) : i][["x", "y"]].dropna()
            a, b = (both[c].rank().to_numpy() for c in ("x", "y"))
            if len(both) < least or len(both) < 2 or a.std() == 0 or b.std() == 0:
                return None
            return float(np.corrcoef(a, b)[0, 1])

        check(pdf, rolling.rank_corr(df, P, "x", "y", n, least, "o"), "o", corr)


def test_small_batches_and_slices(spark, panel):
    pdf, df = panel
    want = {(r.k, r.t): r.o for r in rolling.rank_pct(df, P, {"o": "x"}, 20).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a window spans several batches
    try:
        assert {(r.k, r.t): r.o for r in rolling.rank_pct(df, P, {"o": "x"}, 20).collect()} == want
        falls = {(r.k, r.t): r.o for r in rolling.rolling_drawdown(df, P, "r", 20, "o").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cut = in_slices(df, P, lambda d, p: rolling.rolling_drawdown(d, p, "r", 20, "o"), 19, rows=100)
    got = {(r.k, r.t): r.o for r in cut.collect()}
    assert got.keys() == falls.keys() and all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-12) for k, v in falls.items())
    assert rolling.rank_pct(df.limit(0), P, {"o": "x"}, 5).count() == 0


def test_time_hardly_depends_on_n():
    """Of the order statistics over one batch, without Spark: 1,000 rows a window against 60."""
    rng = np.random.default_rng(2)
    x, first = rng.normal(size=200_000), np.zeros(200_000, np.int64)

    def ranks(n):
        start = time.perf_counter()
        low, full = rolling._windows(first, n, x)
        tree = rolling.Wavelet(x)
        tree.less(low[full], np.flatnonzero(full) + 1, tree.ranks[full])
        return time.perf_counter() - start

    assert min(ranks(1000) for _ in range(3)) < 2 * min(ranks(60) for _ in range(3)) + 0.05
