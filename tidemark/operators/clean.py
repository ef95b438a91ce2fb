"""Cleaning, outliers, imputation and missing-value analysis."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.panel import Panel, div
from ..functions.splines import spline_filled
from .joins import interpolated

NUMBERS = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)


def numeric(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMBERS) and f.name not in but]


def _with_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds the columns of a table of one row."""
    return df.join(F.broadcast(stats), how="cross")


def cleaned(df: DataFrame) -> DataFrame:
    """Without repeated rows, rows and columns that are all NULL; dates and numbers coerced by the column's name."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    df = df.select(*[c for c in df.columns if counts[c]]).dropna("all").dropDuplicates()
    new = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            low = f.name.lower()
            if "date" in low or "day" in low:
                new[f.name] = F.try_to_timestamp(f.name).cast("date")
            elif any(w in low for w in ("price", "volume", "value")):
                new[f.name] = F.expr(f"try_cast(`{f.name}` AS double)")
    return df.withColumns(new) if new else df


def quartile_clipped(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Values brought to within k interquartile ranges of the quartiles (exact, linear)."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    df = _with_row(df, df.agg(*[q(c).alias(f"__{c}") for c in columns]))
    new = {}
    for c in columns:
        a, z = F.col(f"__{c}")[0], F.col(f"__{c}")[1]
        new[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), a - k * (z - a)), z + k * (z - a)))
    return df.withColumns(new).drop(*[f"__{c}" for c in columns])


def outliers_removed(df: DataFrame, columns: Sequence[str], how: str = "iqr", limit: float = 3.0) -> DataFrame:
    """Outliers become NULL: beyond ``limit`` interquartile ranges, deviations (sample) or scaled median deviations."""
    if how == "iqr":
        q = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"__{c}") for c in columns])
        bad = lambda c: (F.col(c) < F.col(f"__{c}")[0] - limit * (F.col(f"__{c}")[1] - F.col(f"__{c}")[0])) | (F.col(c) > F.col(f"__{c}")[1] + limit * (F.col(f"__{c}")[1] - F.col(f"__{c}")[0]))
    elif how == "zscore":
        q = df.agg(*[F.array(F.avg(c), F.stddev_samp(c)).alias(f"__{c}") for c in columns])
        bad = lambda c: F.abs(div(F.col(c) - F.col(f"__{c}")[0], F.col(f"__{c}")[1])) > limit
    elif how == "mad":
        m = df.agg(*[F.median(c).alias(f"__m{c}") for c in columns])
        q = _with_row(df, m).groupBy(*[f"__m{c}" for c in columns]).agg(*[F.median(F.abs(F.col(c) - F.col(f"__m{c}"))).alias(f"__d{c}") for c in columns]).select(*[F.array(f"__m{c}", f"__d{c}").alias(f"__{c}") for c in columns])
        bad = lambda c: F.abs(div(0.6745 * (F.col(c) - F.col(f"__{c}")[0]), F.col(f"__{c}")[1])) > limit
    else:
        raise ValueError(f"unknown method {how}")
    return _with_row(df, q).withColumns({c: F.when(~F.coalesce(bad(c), F.lit(False)), F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns])


def standardized(df: DataFrame, columns: Sequence[str], how: str = "zscore") -> DataFrame:
    """``{column}_normalized``: z-score (sample), min-max or robust (median deviation); NULL without spread."""
    if how == "robust":
        m = df.agg(*[F.median(c).alias(f"__m{c}") for c in columns])
        wide = _with_row(df, m)
        d = wide.groupBy(*[f"__m{c}" for c in columns]).agg(*[F.median(F.abs(F.col(c) - F.col(f"__m{c}"))).alias(f"__s{c}") for c in columns])
        s = d
    elif how == "minmax":
        s = df.agg(*[x for c in columns for x in (F.min(c).alias(f"__m{c}"), (F.max(c) - F.min(c)).alias(f"__s{c}"))])
    else:
        s = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m{c}"), F.stddev_samp(c).alias(f"__s{c}"))])
    return _with_row(df, s).withColumns({f"{c}_normalized": div(F.col(c) - F.col(f"__m{c}"), f"__s{c}") for c in columns}).drop(*[f"__{k}{c}" for c in columns for k in "ms"])


def filled(df: DataFrame, p: Panel, columns: Sequence[str], how: str = "ffill", limit: int | None = None) -> DataFrame:
    """Gaps filled within each series: ffill, bfill (at most ``limit`` in a row), interpolate, mean or median."""
    if how == "interpolate":
        return interpolated(df, p.by, p.time, columns)
    if how in ("mean", "median"):
        f = F.avg if how == "mean" else F.median
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), f(c).over(p.whole)) for c in columns})
    if how == "ffill":
        w = p.so_far if limit is None else p.w.rowsBetween(-limit, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    if limit is None:
        return df.withColumns({c: p.bfill(c) for c in columns})
    return df.withColumns({c: F.first(c, ignorenulls=True).over(p.w.rowsBetween(0, limit)) for c in columns})


def missing_handled(df: DataFrame, p: Panel, columns: Sequence[str]) -> DataFrame:
    """Forward, then backward, then the mean."""
    return filled(filled(filled(df, p, columns, "ffill"), p, columns, "bfill"), p, columns, "mean")


def prepared(df: DataFrame, p: Panel, o: str, h: str, low: str, c: str, v: str) -> DataFrame:
    """Prices forward, volume zero, quartile clip, and then high and low that hold open and close."""
    df = filled(df, p, [o, h, low, c]).withColumn(v, F.coalesce(v, F.lit(0.0)))
    df = quartile_clipped(df, [o, h, low, c, v])
    return df.withColumns({h: F.greatest(h, o, c), low: F.least(low, o, c)})


def finished(df: DataFrame, columns: Sequence[str], scale: bool = False, least_variance: float = 0.01) -> DataFrame:
    """NaN and infinite become the median; columns of little variance (population) go; then z-scores (population) if ``scale``."""
    fine = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
    df = df.withColumns({c: fine(c) for c in columns})
    df = _with_row(df, df.agg(*[F.median(c).alias(f"__{c}") for c in columns])).withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])
    var = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    df = df.drop(*[c for c in columns if var[c] is None or var[c] < least_variance])
    kept = [c for c in columns if c in df.columns]
    if not scale:
        return df
    s = df.agg(*[x for c in kept for x in (F.avg(c).alias(f"__m{c}"), F.stddev_pop(c).alias(f"__s{c}"))])
    return _with_row(df, s).withColumns({c: div(F.col(c) - F.col(f"__m{c}"), f"__s{c}") for c in kept}).drop(*[f"__{k}{c}" for c in kept for k in "ms"])


def missing_counts(df: DataFrame) -> DataFrame:
    """(column_name, missing, share) in one pass."""
    n = len(df.columns)
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__{i}").alias("missing")) for i, c in enumerate(df.columns[:n])]))
    return one.select("__n", rows.alias("r")).select("r.*", div(F.col("r.missing"), "__n").alias("share"))


def missing_patterns(df: DataFrame, columns: Sequence[str], top: int | None = 10) -> DataFrame:
    """(pattern, n): which columns lack a value together; a 1 for each that does."""
    mask = F.concat_ws("", *[F.col(c).isNull().cast("int").cast("string") for c in columns])
    out = df.groupBy(mask.alias("pattern")).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), "pattern").limit(top)


def missing_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of the columns' missing masks."""
    bit = lambda c: F.col(c).isNull().cast("double")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[div(F.covar_samp(bit(a), bit(b)), F.stddev_samp(bit(a)) * F.stddev_samp(bit(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def missing_kind(df: DataFrame, column: str, day: str, others: Sequence[str]) -> DataFrame:
    """One row: weekday chi-square of the mask, the largest correlation with another column, and what they suggest.

    Under 12.59 (six degrees, five percent) it looks completely random; else random if no other column tells it (0.3).
    """
    bit = F.col(column).isNull().cast("double")
    per = df.groupBy(F.weekday(F.col(day).cast("date")).alias("w")).agg(F.count("*").alias("n"), F.sum(bit).alias("m"))
    share = per.agg(F.sum("m").alias("mm"), F.sum("n").alias("nn"))
    chi = _with_row(per, share).agg(F.sum(div(F.pow(F.col("m") - F.col("n") * F.col("mm") / F.col("nn"), 2), F.col("n") * F.col("mm") / F.col("nn"))).alias("chi2"))
    most = df.agg(F.greatest(*[F.coalesce(F.abs(div(F.covar_samp(bit, F.col(c).cast("double")), F.stddev_samp(bit) * F.stddev_samp(F.col(c).cast("double")))), F.lit(0.0)) for c in [*others, others[0]]]).alias("corr"))
    return _with_row(chi, most).withColumn("kind", F.when(F.coalesce("chi2", F.lit(0.0)) < 12.59, "MCAR").when(F.col("corr") < 0.3, "MAR").otherwise("MNAR"))


def strategy(share: float) -> str:
    """By the share that is missing."""
    return "simple" if share < 0.05 else "interpolation" if share < 0.2 else "knn"


def imputed(df: DataFrame, columns: Sequence[str], how: str = "mean", constant: float = 0.0) -> DataFrame:
    """mean, median, mode (the least of the commonest) or a constant."""
    if how == "constant":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(constant)) for c in columns})
    if how == "mode":
        for c in columns:
            top = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n")).agg(F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias("__v"))
            df = _with_row(df, top).withColumn(c, F.coalesce(F.col(c), F.col("__v"))).drop("__v")
        return df
    f = F.avg if how == "mean" else F.median
    return _with_row(df, df.agg(*[f(c).alias(f"__{c}") for c in columns])).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])


def auto_imputed(df: DataFrame, p: Panel, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Gaps filled by what their share of all cells asks for (``strategy``): means, lines within each series, or nearest rows.

    One pass counts the gaps. Without rows or columns nothing is missing, and the means fill nothing.
    """
    if not columns:
        return df
    gaps = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    share = df.agg(div(F.sum(gaps), F.count("*") * len(columns))).first()[0] or 0.0
    how = strategy(share)
    if how == "simple":
        return imputed(df, columns, "mean")
    return filled(df, p, columns, "interpolate") if how == "interpolation" else knn_imputed(df, p.by, columns, k)


def knn_imputed(df: DataFrame, by: Sequence[str], columns: Sequence[str], k: int = 5, donors: int = 2_000) -> DataFrame:
    """Mean of the k nearest rows of the same series that know the value, by distance over what both know.

    Ties go to the smaller value; without a donor, the mean of the series. Equal rows are compared once, with their number.
    A series' rows with gaps and its donors are cut in blocks of about ``donors``, and every block of the ones meets every
    block of the others: each pair keeps k candidates per row and column, and these are merged to the k nearest of all.
    """
    by, columns = list(by), list(columns)
    exact = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    gap = F.exists("__x", lambda e: e.isNull())
    rows = df.withColumn("__x", F.array(*map(exact, columns)))
    vectors = rows.groupBy(*by, "__x").agg(F.count("*").alias("__n"))
    means = F.array(*[div(F.sum(F.col("__x")[j] * F.col("__n")), F.sum(F.when(F.col("__x")[j].isNotNull(), F.col("__n")))) for j in range(len(columns))])
    blocks = lambda n: F.greatest(F.ceil(n / donors), F.lit(1)).cast("int")
    series = vectors.groupBy(*by).agg(blocks(F.count_if(gap)).alias("__as"), blocks(F.count("*")).alias("__bs"), means.alias("__m"))
    tagged = vectors.join(series.withColumnsRenamed({c: f"__s_{c}" for c in by}), F.struct(*by) == F.struct(*[f"__s_{c}" for c in by]))
    own, all_of = lambda n: F.pmod(F.xxhash64("__x"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = tagged.where(gap)
    asked = asking.select(*by, own("__as").alias("__a"), all_of("__bs").alias("__b"), "__x")
    given = tagged.where(F.exists("__x", lambda e: e.isNotNull())).select(*by, all_of("__as").alias("__a"), own("__bs").alias("__b"), "__x", "__n")
    given = given.select(*[F.col(c).alias(c) for c in given.columns])  # attributes of its own beside those of asked
    schema = T.StructType([*[df.schema[c] for c in by], *T._parse_datatype_string("__x array<double>, __j int, __d double, __y double, __n long").fields])

    def pair(asks: pa.Table, gives: pa.Table) -> pa.Table:
        matrix = lambda t: t.column("__x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int32), *[np.zeros(0)] * 2, np.zeros(0, np.int64))]
        if asks.num_rows and gives.num_rows:
            q, x, n = matrix(asks), matrix(gives), gives.column("__n").to_numpy()
            known, step = ~np.isnan(x), max(1, 1_000_000 // len(x))
            ranks = [o[known[o, j]] for j, o in enumerate(np.argsort(x, axis=0, kind="stable").T)]  # who knows the column, by value
            for at in range(0, len(q), step):
                part = q[at : at + step]
                total, both = np.zeros((len(part), len(x))), np.zeros((len(part), len(x)))
                for c in range(x.shape[1]):
                    ok = ~np.isnan(part[:, c])[:, None] & known[:, c]
                    total += np.where(ok, part[:, c][:, None] - x[:, c], 0.0) ** 2
                    both += ok
                d = np.where(both > 0, total * x.shape[1] / np.maximum(both, 1), np.inf)
                for j, rank in enumerate(ranks):
                    who = np.flatnonzero(np.isnan(part[:, j]))
                    near = np.argsort(d[who][:, rank], axis=1, kind="stable")[:, :k]
                    row, donor = np.repeat(who, near.shape[1]), rank[near.ravel()]
                    fits = np.isfinite(d[row, donor])
                    row, donor = row[fits], donor[fits]
                    parts.append((row + at, np.full(len(row), j, np.int32), d[row, donor], x[donor, j], n[donor]))
        row, *rest = map(np.concatenate, zip(*parts, strict=True))
        return pa.table([*[asks.column(c).take(pa.array(row)) for c in [*by, "__x"]], *map(pa.array, rest)], names=schema.names)

    pairs = asked.groupBy(*by, "__a", "__b").cogroup(given.groupBy(*by, "__a", "__b")).applyInArrow(pair, schema)
    fallback = asking.select(*by, "__x", F.posexplode("__m").alias("__j", "__y")).select(*by, "__x", "__j", F.lit(float("inf")).alias("__d"), "__y", F.lit(1).cast("long").alias("__n"))
    found = pairs.unionByName(fallback).where("__y is not null").groupBy(*by, "__x", "__j").agg(F.array_sort(F.collect_list(F.struct("__d", "__y", "__n"))).alias("t"))
    near = F.slice(F.filter("t", lambda e: e["__d"] < float("inf")), 1, k)
    values = F.slice(F.flatten(F.transform(near, lambda e: F.array_repeat(e["__y"], F.least(e["__n"], F.lit(k)).cast("int")))), 1, k)
    mean = F.when(F.size(near) == 0, F.col("t")[0]["__y"]).otherwise(F.aggregate(values, F.lit(0.0), lambda s, e: s + e) / F.size(values))
    answers = found.select(*by, "__x", "__j", mean.alias("v")).groupBy(*by, "__x").agg(F.map_from_entries(F.collect_list(F.struct("__j", "v"))).alias("__v"))
    out = lambda f: [f(columns.index(c)).alias(c) if c in columns else c for c in df.columns]
    answers = answers.withColumnsRenamed({c: f"__s_{c}" for c in [*by, "__x"]})
    filled = rows.where(gap).join(answers, F.struct(*by, "__x") == F.struct(*[f"__s_{c}" for c in [*by, "__x"]]), "left")
    return rows.where(~gap).select(out(lambda j: F.col("__x")[j])).union(filled.select(out(lambda j: F.coalesce(F.col("__x")[j], F.col("__v")[j]))))


def interpolation_imputed(df: DataFrame, p: Panel, columns: Sequence[str], how: str = "linear", order: int = 2) -> DataFrame:
    """linear (by row), time (by date), polynomial (a spline of degree ``order`` by row) or spline (a cubic one); ends filled with the nearest."""
    if how == "linear":
        out = interpolated(df, p.by, p.time, columns)
        return filled(out, p, columns, "bfill")
    if how in ("polynomial", "spline"):
        return spline_filled(df, p, list(columns), order if how == "polynomial" else 3)
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in columns else f.dataType) for f in df.schema.fields])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(p.time), kind="stable")
        t = pd.to_datetime(pdf[p.time[0]]).astype("int64").to_numpy().astype(float)
        for c in columns:
            x = pdf[c].astype(float).to_numpy()
            ok = ~np.isnan(x)
            if ok.any() and not ok.all():
                x = np.where(ok, x, np.interp(t, t[ok], x[ok]))
            pdf = pdf.assign(**{c: x})
        return pdf[schema.names]

    return df.groupBy(*p.by).applyInPandas(one, schema)


def forest_imputed(df: DataFrame, column: str, features: Sequence[str], trees: int = 20, seed: int = 42) -> DataFrame:
    """Missing values of one column predicted by a random forest over the others (their gaps filled by the median)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    given = imputed(df.withColumns({f"__{f}": F.col(f) for f in features}), [f"__{f}" for f in features], "median")
    ready = VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="__x", handleInvalid="skip").transform(given)
    model = RandomForestRegressor(featuresCol="__x", labelCol=column, predictionCol="__p", numTrees=trees, seed=seed).fit(ready.where(F.col(column).isNotNull()))
    return model.transform(ready).withColumn(column, F.coalesce(F.col(column), F.col("__p"))).select(*df.columns)


def imputation_report(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, missing before and after, change of mean and deviation)."""
    stat = lambda df, k: df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("m"), F.avg(c).alias("a"), F.stddev_samp(c).alias("s")).alias(f"{k}{i}") for i, c in enumerate(columns)])
    both = _with_row(stat(before, "b"), stat(after, "a"))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"b{i}.m").alias("missing_before"), F.col(f"a{i}.m").alias("missing_after"), (F.col(f"a{i}.a") - F.col(f"b{i}.a")).alias("mean_change"), (F.col(f"a{i}.s") - F.col(f"b{i}.s")).alias("std_change")) for i, c in enumerate(columns)]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def integral(df: DataFrame) -> list[str]:
    """Floating columns that hold whole numbers only: these may be read as integers."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    if not names:
        return []
    row = df.agg(*[F.coalesce(F.bool_and(F.col(c) == F.floor(c)), F.lit(False)).alias(c) for c in names]).first()
    return [c for c in names if row[c]]


def column_types(df: DataFrame, few: float = 0.5) -> DataFrame:
    """(column_name, kind): 'integer' for floating columns of whole numbers without gaps, 'category' for text with fewer distinct values than ``few`` of the rows, else 'as it is'.

    One aggregation for the numbers, one for the texts; an empty table's columns are as they are.
    """
    fields = df.schema.fields
    floats = [f.name for f in fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    whole = lambda c: F.coalesce(F.bool_and(F.nvl(F.col(f"`{c}`") == F.floor(f"`{c}`"), F.lit(False))), F.lit(False))
    scarce = lambda c: F.coalesce(div(F.count_distinct(F.col(f"`{c}`")), F.count("*")) < few, F.lit(False))
    rows = [F.struct(F.lit(c).alias("column_name"), F.when(whole(c), "integer").otherwise("as it is").alias("kind")) for c in floats]
    texts = [F.struct(F.lit(c).alias("column_name"), F.when(scarce(c), "category").otherwise("as it is").alias("kind")) for c in strings]
    told = [df.agg(F.array(*r).alias("r")).select(F.explode("r").alias("r")).select("r.*") for r in (rows, texts) if r]
    others = [c for c in df.columns if c not in {*floats, *strings}]
    if others:
        told.append(df.sparkSession.createDataFrame([(c, "as it is") for c in others], "column_name string, kind string"))
    out = told[0]
    for t in told[1:]:
        out = out.union(t)
    return out


def integers(df: DataFrame) -> DataFrame:
    """``df`` with its floating columns of whole numbers as integers; gaps, infinite values and those beyond 64 bits keep a column as it is."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    if not names:
        return df
    fits = lambda c: F.nvl((F.col(f"`{c}`") == F.floor(f"`{c}`")) & (F.abs(F.col(f"`{c}`")) < 2.0**63), F.lit(False))
    row = df.agg(*[F.coalesce(F.bool_and(fits(c)), F.lit(False)).alias(f"__{i}") for i, c in enumerate(names)]).first()
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for i, c in enumerate(names) if row[i]})
