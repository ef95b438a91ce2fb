"""Text, activity and weather features, and column transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.panel import Panel, div, flag
from ..functions.slices import ROWS, in_slices, numbered

#: Ordered rules of event types; the last that matches counts.
EVENTS = (("earnings", "earnings|profit|revenue"), ("merger", "merger|acquisition|takeover"), ("policy", "policy|regulation|government"), ("product", "launch|product|release"))
KEYWORDS = ("growth", "decline", "profit", "loss", "risk", "opportunity")
POSITIVE = ("good", "great", "gain", "growth", "profit", "strong", "up", "win", "positive", "improve")
NEGATIVE = ("bad", "poor", "loss", "decline", "weak", "down", "risk", "fail", "negative", "worse")


def sentiment(text: str, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """Polarity in [-1, 1]: positive less negative words over both; 0 without either. A small lexicon, in plain Spark."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+")
    hit = lambda names: F.size(F.filter(words, lambda w: w.isin(*names)))
    return F.coalesce(div((hit(positive) - hit(negative)).cast("double"), hit(positive) + hit(negative)), F.lit(0.0))


def keyword_counts(df: DataFrame, text: str, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """How often each keyword stands as a word, in any case."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumns({f"kw_{k}": F.regexp_count(low, F.lit(rf"\b{k}\b")) for k in keywords})


def event_type(text: str, rules: Sequence[tuple[str, str]] = EVENTS) -> Column:
    low, out = F.lower(F.coalesce(F.col(text), F.lit(""))), None
    for name, pattern in reversed(rules):
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("other")


def activity(df: DataFrame, p: Panel, a: str, b: str, target: str, short: int = 7, long: int = 30) -> DataFrame:
    """Mean of one series, change of both, and the correlation of the first with a target."""
    return df.withColumns({f"{a}_MA{short}": p.mean(a, short), f"{a}_Change": p.pct(a), f"{b}_Change": p.pct(b), f"{a}_{target}_Corr": p.corr(a, target, long)})


def weather(df: DataFrame, p: Panel, temperature: str, price: str, n: int = 30) -> DataFrame:
    df = df.withColumn("Temp_Anomaly", p.zscore(temperature, n))
    return df.withColumns({"Weather_Price_Corr": p.corr(temperature, price, n), "Extreme_Weather": flag(F.abs(F.col("Temp_Anomaly")) > 2)})


# transforms


def normalized(df: DataFrame, p: Panel, columns: Sequence[str], how: str = "zscore") -> DataFrame:
    """Over each series as a whole: by population deviation, or to [0, 1]."""
    w = p.whole
    if how == "zscore":
        return df.withColumns({f"{c}_norm": div(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)) for c in columns})
    return df.withColumns({f"{c}_norm": div(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)) for c in columns})


def differenced(df: DataFrame, p: Panel, columns: Sequence[str], order: int = 1) -> DataFrame:
    return df.withColumns({f"{c}_diff{order}": p.diff(c, order) for c in columns})


def logged(df: DataFrame, columns: Sequence[str], eps: float = 1e-8) -> DataFrame:
    return df.withColumns({f"{c}_log": F.when(F.col(c) + eps > 0, F.ln(F.col(c) + eps)) for c in columns})


def binned(df: DataFrame, column: str, bins: int = 5, how: str = "quantile", by: Sequence[str] = ()) -> DataFrame:
    """Number of the bin from 0: by exact linear quantiles, or of equal width; right-closed."""
    if how == "quantile":
        edges = df.groupBy(*by).agg(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("__e"))
    else:
        lo, hi = F.min(column), F.max(column)
        edges = df.groupBy(*by).agg(F.array(*[lo + (hi - lo) * (i / bins) for i in range(bins + 1)]).alias("__e"))
    df = df.join(F.broadcast(edges), list(by)) if by else df.join(F.broadcast(edges), how="cross")  # one row of edges
    inner = F.array_distinct(F.slice("__e", 2, bins - 1))
    return df.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(column))))).drop("__e")


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]], eps: float = 1e-8) -> DataFrame:
    new = {}
    for a, b in pairs:
        new |= {f"{a}_div_{b}": div(a, F.col(b) + eps), f"{a}_mul_{b}": F.col(a) * F.col(b), f"{a}_sub_{b}": F.col(a) - F.col(b)}
    return df.withColumns(new)


def component_scores(df: DataFrame, columns: Sequence[str], k: int) -> list[Column]:
    """Expressions PC1.. of the first k components of the standardized columns (population deviation).

    The correlation matrix is one aggregation; its eigenvectors are small and go back as literals. The sign makes the
    largest loading positive.
    """
    known = df.dropna(subset=list(columns))
    aggs = [f for c in columns for f in (F.avg(c), F.stddev_pop(c))] + [F.covar_pop(a, b) for a in columns for b in columns]
    row = list(known.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first())
    n = len(columns)
    mean, std = np.array(row[0 : 2 * n : 2], float), np.array(row[1 : 2 * n : 2], float)
    std = np.where(std > 0, std, 1.0)
    values, vectors = np.linalg.eigh(np.array(row[2 * n :], float).reshape(n, n) / np.outer(std, std))
    vectors = vectors[:, np.argsort(-values)[:k]]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(k)])
    return [sum(((F.col(c) - float(mean[i])) / float(std[i]) * float(vectors[i, j]) for i, c in enumerate(columns)), F.lit(0.0)).alias(f"PC{j + 1}") for j in range(k)]


def principal_components(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    return df.select("*", *component_scores(df, columns, k))


def fourier(df: DataFrame, by: Sequence[str], time: str, column: str, n: int = 3) -> DataFrame:
    """One row a series: the n largest amplitudes of its spectrum without the constant, and their frequencies."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name in by], *[T.StructField(f"{column}_fft_{k}_{i + 1}", T.DoubleType()) for i in range(n) for k in ("amp", "freq")]])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time)[column].astype(float).fillna(0.0).to_numpy()
        half = np.arange(1, len(x) // 2 + 1)
        amp = np.abs(np.fft.fft(x))[half] if len(half) else np.zeros(0)
        top = np.argsort(-amp, kind="stable")[:n]
        values = [v for i in range(n) for v in ((amp[top[i]], half[top[i]] / len(x)) if i < len(top) else (np.nan, np.nan))]
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), *values]], columns=schema.names)

    return df.select(*by, time, column).groupBy(*by).applyInPandas(one, schema)


def daubechies(order: int = 4) -> np.ndarray:
    """Low-pass filter with ``order`` vanishing moments, by spectral factorization (minimum phase)."""
    poly = np.poly1d([0.0])
    y = np.poly1d([-0.25, 0.5, -0.25])  # (2 - z - 1/z) / 4, times z
    for k in range(order):
        poly = poly + math.comb(order - 1 + k, k) * y**k * np.poly1d([1.0] + [0.0] * (order - 1 - k))
    roots = [r for r in poly.roots if abs(r) < 1]
    h = np.poly1d([1.0])
    for _ in range(order):
        h = h * np.poly1d([1.0, 1.0])
    for r in roots:
        h = h * np.poly1d([1.0, -r])
    h = np.real(h.coeffs)
    return h * (math.sqrt(2) / h.sum())


def _reflected(df: DataFrame, by: Sequence[str], taps: int) -> DataFrame:
    """(by, i, x) of series numbered from 0, with rows before the first and after the last that mirror them, end rows repeated."""
    n, i = F.count("*").over(Window.partitionBy(*by)).cast("int"), F.col("i")
    df = df.withColumn("__n", n)
    n = F.col("__n")
    source = lambda e: F.when(F.pmod(e, 2 * n) < n, F.pmod(e, 2 * n)).otherwise(2 * n - 1 - F.pmod(e, 2 * n))
    beyond = F.concat(F.sequence(F.lit(2 - taps), F.lit(-1)), F.sequence(n, n + taps - 2))
    more = F.when((i < taps) | (i >= n - taps), F.filter(beyond, lambda e: source(e) == i)).otherwise(F.array().cast("array<int>"))
    return df.select(*by, F.explode(F.concat(F.array(i), more)).alias("i"), "x")


def wavelet_bands(df: DataFrame, by: Sequence[str], time: str, column: str, level: int = 3, order: int = 4, rows: int = ROWS) -> list[tuple[str, DataFrame]]:
    """The bands of a discrete wavelet transform with mirrored ends: (name, (by, i, x)) of the details from the finest on, and of the approximation.

    A band of n values gives two of (n + taps - 1) // 2. A coefficient needs the values of one window, so series of more
    than ``rows`` rows are filtered in overlapping slices.
    """
    low = daubechies(order)
    taps, out = len(low), []
    filters = {"a": low[::-1], "d": low * (-1.0) ** (np.arange(len(low)) + 1)}
    now = numbered(df, Panel(tuple(by), (time,)), rows).select(*by, F.col("__row").cast("int").alias("i"), F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("x"))
    for k in range(1, level + 1):
        ends = _reflected(now, by, taps)
        add = lambda d, p: d.withColumns({n: sum((float(c) * p.lag("x", j) if j else float(c) * F.col("x") for j, c in enumerate(f)), F.lit(0.0)) for n, f in filters.items()})
        both = in_slices(ends, Panel(tuple(by), ("i",)), add, taps - 1, rows=rows).where("i >= 1 AND i % 2 = 1").select(*by, F.expr("CAST((i - 1) DIV 2 AS INT)").alias("i"), "a", "d")
        out.append((f"{column}_D{k}", both.select(*by, "i", F.col("d").alias("x"))))
        now = both.select(*by, "i", F.col("a").alias("x"))
    return [*out, (f"{column}_A{level}", now)]


def wavelet(df: DataFrame, by: Sequence[str], time: str, column: str, level: int = 3, order: int = 4, rows: int = ROWS) -> DataFrame:
    """One row a series: the mean of each band's coefficients, the approximation's first; a missing value counts as zero."""
    bands = wavelet_bands(df, by, time, column, level, order, rows)
    every = reduce(DataFrame.unionByName, [b.groupBy(*by).agg(F.avg("x").alias("m")).withColumn("band", F.lit(n)) for n, b in bands])
    return every.groupBy(*by).agg(*[F.max(F.when(F.col("band") == n, F.col("m"))).alias(n) for n, _ in reversed(bands)])
