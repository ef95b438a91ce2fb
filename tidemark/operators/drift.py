"""Distribution drift between a reference and a current table. Only sums by distinct value or bin are ordered, never raw rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import running_sums
from ..functions.panel import div
from .alternative import component_scores


def _cdf(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, x, f, g): both empirical distributions at every distinct value."""
    long = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*", F.lit(side).alias("side")).where("x IS NOT NULL AND NOT isnan(x)")
    per = long(ref, 0).union(long(cur, 1)).groupBy("feature", "x").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    size = per.groupBy("feature").agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    got = running_sums(per, ["feature"], "x", {"__f": "a", "__g": "b"}).join(F.broadcast(size), "feature")
    return got.withColumns({"f": div("__f", "n"), "g": div("__g", "m")}).drop("__f", "__g")


def ks_p(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p of the two-sample statistic (Kolmogorov's series)."""
    if d <= 0:
        return 1.0
    z = d * math.sqrt(n * m / (n + m))
    if z < 0.3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


def _with_p(got: DataFrame, alpha: float) -> DataFrame:
    """Kolmogorov's p of ``statistic`` with n and m rows, the score and whether that is drift."""
    z = F.col("statistic") * F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    series = sum(((-1) ** (k - 1) * F.exp(-2.0 * k * k * z * z) for k in range(1, 30)), F.lit(0.0)) * 2
    p = F.when(z < 0.3, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return got.withColumn("p_value", p).withColumns({"score": 1 - F.col("p_value"), "drifted": F.col("p_value") < alpha})


def ks(ref: DataFrame, cur: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(feature, statistic, n, m, p_value, score, drifted) of the two-sample Kolmogorov-Smirnov test."""
    got = _cdf(ref, cur, columns).groupBy("feature").agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("statistic"), F.max("n").alias("n"), F.max("m").alias("m"))
    return _with_p(got, alpha)


def history(df: DataFrame, period: str, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Each period against the one before it, all in one job: (period, feature, statistic, n, m, p_value, score, drifted) of ``ks``.

    A row counts twice, for its own period and as what the next one is compared with. Only sums by distinct value go on
    from there. Periods times columns should be some thousands at most. NULL periods, NULL and NaN values take no part; a period
    without a value of a feature gives no row of it.
    """
    d = df.where(F.col(period).isNotNull())
    later = d.select(F.col(period).alias("__p")).distinct()
    later = later.withColumn("__next", F.lead("__p").over(Window.partitionBy(F.lit(0)).orderBy("__p")))  # a row for each period
    d = d.join(F.broadcast(later), F.col(period) == F.col("__p"))
    sides = F.array(F.struct(F.col("__p").alias("period"), F.lit(1).alias("side")), F.struct(F.col("__next").alias("period"), F.lit(0).alias("side")))
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = d.select(F.explode(values).alias("v"), sides.alias("s")).where("v.x IS NOT NULL AND NOT isnan(v.x)").select("v.*", F.explode("s").alias("s")).select("feature", "x", "s.*").where("period IS NOT NULL")
    per = long.groupBy("period", "feature", "x").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    size = per.groupBy("period", "feature").agg(F.sum("a").alias("n"), F.sum("b").alias("m")).where("n > 0 AND m > 0")
    cdf = running_sums(per, ["period", "feature"], "x", {"__f": "a", "__g": "b"}).join(F.broadcast(size), ["period", "feature"])
    got = cdf.groupBy("period", "feature").agg(F.max(F.abs(F.col("__f") / F.col("n") - F.col("__g") / F.col("m"))).alias("statistic"), F.max("n").alias("n"), F.max("m").alias("m"))
    return _with_p(got, alpha)


def summary(found: DataFrame, since: object = None, top: int = 5) -> DataFrame:
    """One row over the detections of a history from ``since`` on: a detection is a period's row of features.

    Number of detections, those with a drifted feature and their share, mean and largest of the detections' mean scores, and the
    ``top`` features that drifted most often (ties by name). Without detections the counts are 0, the rest NULL or empty.
    """
    d = found if since is None else found.where(F.col("period") >= F.lit(since))
    one = d.groupBy("period").agg(F.avg("score").alias("score"), F.max("drifted").alias("drifted"))
    one = one.agg(F.count("*").alias("detections"), F.count_if("drifted").alias("with_drift"), F.avg(F.col("drifted").cast("double")).alias("drift_rate"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
    often = d.where("drifted").groupBy("feature").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "feature").limit(top)
    often = often.agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "feature"))).alias("r")).select(F.concat_ws(",", "r.feature").alias("most_drifted"))  # top rows
    return one.join(often, how="cross")  # one row each


def wasserstein(ref: DataFrame, cur: DataFrame, columns: Sequence[str], limit: float = 0.1) -> DataFrame:
    """(feature, distance, relative, score, drifted): area between the distributions; relative to the reference's sample deviation.

    A feature has drifted if that is over ``limit``; the score is the relative distance over the limit, 1 at most.
    """
    got = _cdf(ref, cur, columns).withColumn("__a", F.abs(F.col("f") - F.col("g")) * (F.col("__next") - F.col("x"))).groupBy("feature").agg(F.sum("__a").alias("distance"))
    std = ref.agg(*[F.stddev_samp(c).alias(c) for c in columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("std")) for c in columns])).alias("r")).select("r.*")
    got = got.join(F.broadcast(std), "feature").withColumn("relative", F.coalesce(div("distance", "std"), F.lit(0.0)))
    return got.withColumns({"score": F.least(F.lit(1.0), F.col("relative") / limit), "drifted": F.col("relative") > limit}).drop("std")


def chi2(ref: DataFrame, cur: DataFrame, columns: Sequence[str], bins: int = 9, critical: float = 15.507) -> DataFrame:
    """(feature, statistic, drifted): counts in equal bins over the joint range; the expected ones are the reference's share."""
    long = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*", F.lit(side).alias("side")).where("x IS NOT NULL")
    both = long(ref, 0).union(long(cur, 1))
    span = both.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(div((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))).cast("int"), F.lit(0)))
    per = both.join(F.broadcast(span), "feature").groupBy("feature", at.alias("bin")).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    all_ = Window.partitionBy("feature")
    exp = (F.col("a") + 1e-10) * F.sum("b").over(all_) / F.sum("a").over(all_)
    return per.withColumn("__e", exp).groupBy("feature").agg(F.sum(F.pow(F.col("b") - F.col("__e"), 2) / F.col("__e")).alias("statistic")).withColumn("drifted", F.col("statistic") > critical)


def label_drift(ref: DataFrame, cur: DataFrame, label: str, limit: float = 0.2) -> DataFrame:
    """One row: mean absolute change of the labels' shares."""
    share = lambda df, name: df.groupBy(label).agg(F.count("*").alias("__n")).withColumn(name, F.col("__n") / F.sum("__n").over(Window.partitionBy())).drop("__n")
    both = share(ref, "p").join(share(cur, "q"), label, "full")
    return both.agg(F.avg(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("change")).withColumn("drifted", F.col("change") > limit)


def concept_drift(ref: DataFrame, cur: DataFrame, label: str, limit: float = 0.2) -> DataFrame:
    """One row: mean absolute change of the shares of the labels that both tables have, 1 if they have none in common."""
    count = lambda df, name: df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias(name))
    a, b = count(ref, "a"), count(cur, "b")
    size = a.agg(F.sum("a").alias("n")).join(b.agg(F.sum("b").alias("m")), how="cross")  # one row each
    both = a.join(b, label).join(F.broadcast(size), how="cross").agg(F.avg(F.abs(F.col("a") / F.col("n") - F.col("b") / F.col("m"))).alias("score"))
    return both.withColumn("score", F.coalesce("score", F.lit(1.0))).withColumn("drifted", F.col("score") > limit)


def score_drop(ref: DataFrame, cur: DataFrame, features: Sequence[str], target: str, kind: str = "ridge", limit: float = 0.1, **how) -> DataFrame:
    """One row: r2 on both tables of a model that is fitted on the reference, its fall, and whether that is over ``limit``.

    Each table is computed once.
    """
    from pyspark.ml.evaluation import RegressionEvaluator

    from .model import fitted, kept

    names = [*features, target]
    with kept(ref.dropna(subset=names), names) as known:
        model = fitted(known, features, kind, target, **how)
        of = lambda df: float(RegressionEvaluator(labelCol=target, metricName="r2").evaluate(model.transform(df)))
        before, after = of(known), of(cur.dropna(subset=names))
    return ref.sparkSession.createDataFrame([(before, after, before - after, before - after > limit)], "before double, after double, fall double, drifted boolean")


def covariate(ref: DataFrame, cur: DataFrame, columns: Sequence[str], k: int = 3, limit: float = 0.8) -> DataFrame:
    """One row: mean KS score over the reference's first principal components."""
    k = min(k, len(columns))
    names = [f"PC{j + 1}" for j in range(k)]
    scores = component_scores(ref, columns, k)
    return ks(ref.select(*scores), cur.select(*scores), names).agg(F.avg("score").alias("score")).withColumn("drifted", F.col("score") > limit)


def density_ratio(ref: DataFrame, cur: DataFrame, columns: Sequence[str], grid: int = 100, limit: float = 0.5, bins: int = 2000) -> DataFrame:
    """(feature, spread, drifted): deviation of the ratio of Gaussian kernel densities over a grid.

    Both samples are first counted in fine bins over their joint range, so the kernel sum runs over bins and not rows.
    """
    out = None
    for c in columns:
        both = ref.select(F.col(c).cast("double").alias("x"), F.lit(0).alias("side")).union(cur.select(F.col(c).cast("double"), F.lit(1))).where("x IS NOT NULL")
        s = both.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), *[f(F.when(F.col("side") == k, F.col("x"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("s", F.stddev_samp), ("n", F.count))])
        wide = both.join(F.broadcast(s), how="cross")  # one row
        w = (F.col("hi") - F.col("lo")) / bins
        per = wide.groupBy(F.least(F.lit(bins - 1), F.coalesce(F.floor(div(F.col("x") - F.col("lo"), w)), F.lit(0)).cast("int")).alias("b")).agg(F.count_if(F.col("side") == 0).alias("a0"), F.count_if(F.col("side") == 1).alias("a1"))
        per = per.join(F.broadcast(s), how="cross").withColumn("m", F.col("lo") + (F.col("b") + 0.5) * w)
        per = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g")).withColumn("at", F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / (grid - 1))
        kernel = lambda k: F.sum(F.col(f"a{k}") * F.exp(-0.5 * F.pow(div(F.col("at") - F.col("m"), F.col(f"s{k}") * F.pow(F.col(f"n{k}"), F.lit(-0.2))), 2)) / (F.col(f"n{k}") * F.col(f"s{k}") * F.pow(F.col(f"n{k}"), F.lit(-0.2))))
        one = per.groupBy("g").agg(kernel(0).alias("p"), kernel(1).alias("q")).agg(F.stddev_pop((F.col("q") + 1e-10) / (F.col("p") + 1e-10)).alias("spread")).select(F.lit(c).alias("feature"), "spread", (F.col("spread") > limit).alias("drifted"))
        out = one if out is None else out.union(one)
    return out


def most_drifted(results: DataFrame, top: int = 5) -> DataFrame:
    return results.orderBy(F.desc("score"), "feature").limit(top)
