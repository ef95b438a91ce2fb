"""Long series in slices give what whole series give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel, ema
from tidemark.functions.slices import below, ema_in_slices, in_slices, running, sliced
from tidemark.operators import price, technical

P = Panel(("k",), ("t",))


@pytest.fixture(scope="module")
def long(spark):
    rng, rows = np.random.default_rng(11), []
    for k, n in (("a", 5000), ("b", 700), ("c", 40), (None, 900)):
        x = np.round(100 * np.cumprod(1 + rng.normal(0, 0.01, n)), 4)
        gap = rng.random(n) < 0.2
        gap[300:650] = True  # spans more than one slice
        for i in range(n):
            rows.append((k, i * 3 if i % 7 else i * 3 - 1, None if gap[i] else float(x[i]), float(x[i])))
    rows += [("d", 5, float(i), 1.0 + i) for i in range(600)]  # one time: cannot be cut
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "t", "x", "full"]).astype({"k": object, "t": "int64"}).replace({np.nan: None}), "k string, t long, x double, full double").repartition(5)


def frame(df, keys=("k", "t")):
    out = df.toPandas()
    return out.sort_values([*keys, "full"], na_position="first", ignore_index=True)


def same(a, b, columns):
    a, b = frame(a), frame(b)
    assert len(a) == len(b)
    for c in columns:
        x, y = a[c].to_numpy(float), b[c].to_numpy(float)
        assert np.array_equal(np.isnan(x), np.isnan(y)), c
        assert np.allclose(x, y, rtol=1e-9, atol=1e-9, equal_nan=True), (c, np.nanmax(np.abs(x - y)))


def test_below(spark):
    df = spark.range(40).select(F.array(*[F.lit(b) for b in (2, 3, 3, 9, 20, 21, 30)]).alias("b"), "id")
    got = df.select("id", below(F.col("b"), F.col("id"), 7).alias("n")).collect()
    assert all(r.n == sum(b < r.id for b in (2, 3, 3, 9, 20, 21, 30)) for r in got)


def test_slices_cover_and_number_rows(long):
    s = sliced(long, P, 250)
    got = s.numbered().toPandas()
    assert len(got) == 7240 and s.starts[("a",)][-1] == 5000 and s.starts[("d",)][-1] == 600
    sizes = got[got.k == "a"].groupby("__slice").size()
    assert len(sizes) >= 18 and sizes.max() < 400
    a = got[got.k == "a"].sort_values("t")
    assert a["__row"].tolist() == list(range(5000)) and a["__slice"].is_monotonic_increasing
    assert set(got[got.k == "c"]["__slice"]) == {0}
    assert sliced(long.limit(0), P, 250).starts == {}


def test_windows_with_halos(long):
    d = long.where("k is null or k <> 'd'")
    add = lambda df, p: df.withColumns({"m": p.mean("full", 60), "l": p.lag("full", 300), "n": p.lead("full", 5), "s": p.std("x", 20)})
    same(add(d, P), in_slices(d, P, add, 300, 5, rows=120), ["m", "l", "n", "s"])  # halos of several slices
    ready = d.select("k", "t", F.col("full").alias("ClosePrice"), "full")
    for f in (lambda df, p: price.momentum(df, p, price.Bar()), lambda df, p: technical.rsi(df, p, price.Bar())):
        want = f(ready, P)
        same(want, in_slices(ready, P, f, 300, rows=500), [c for c in want.columns if c not in ("k", "t")])


def test_running_values(long):
    kinds = {"total": ("sum", "x"), "n": ("count", "x"), "low": ("min", "x"), "high": ("max", F.col("full") * 2), "known": ("last", "x")}
    d = long.where("k is null or k <> 'd'")
    same(running(d, P, kinds, rows=10**9), running(d, P, kinds, rows=250), list(kinds))
    assert running(d.limit(0), P, kinds, rows=5).count() == 0


@pytest.mark.parametrize("adjust", [False, True])
def test_exponential_means(long, adjust):
    d = long.where("k is null or k <> 'd'")
    spans = {"a": ("x", 12), "b": ("x", 26), "c": (("a", "b"), 9), "e": ("full", 5)}
    same(ema(d, P, spans, adjust), ema_in_slices(d, P, spans, adjust, rows=250), list(spans))
