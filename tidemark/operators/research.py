"""Feature evaluation, selection, signals and back-test statistics."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import running_sums
from ..functions.panel import Panel, div
from ..functions.rolling import rank_corr, rank_pct, rolling_drawdown

# information coefficients


def _ranked(df: DataFrame, by: Sequence[str], x: str, name: str) -> DataFrame:
    """Average ranks within ``by``, of the values' counts, so that a group is never ordered row by row."""
    w = Window.partitionBy(*by)
    per = df.groupBy(*by, x).agg(F.count("*").alias("__n")).withColumn(name, F.sum("__n").over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)))
    return per.withColumn(name, F.coalesce(name, F.lit(0)) + (F.col("__n") + 1) / 2).drop("__n")


def rank_ic(df: DataFrame, by: Sequence[str], feature: str, target: str, least: int = 3) -> DataFrame:
    """(by, ic, n): Spearman correlation within each group of ``by``."""
    df = df.select(*by, F.col(feature).alias("__x"), F.col(target).alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    r = df.join(_ranked(df, by, "__x", "__rx"), [*by, "__x"]).join(_ranked(df, by, "__y", "__ry"), [*by, "__y"])
    out = r.groupBy(*by).agg(F.count("*").alias("n"), div(F.covar_samp("__rx", "__ry"), F.stddev_samp("__rx") * F.stddev_samp("__ry")).alias("ic"))
    return out.where(F.col("n") >= least)


def unpivoted(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keep, feature, value)."""
    return df.unpivot(list(keep), list(columns), "feature", "value")


def ic_summary(ics: DataFrame, by: Sequence[str] = (), strong: float = 0.05) -> DataFrame:
    """Mean, deviation, their ratio and the share of strong coefficients."""
    return ics.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), div(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg((F.abs("ic") > strong).cast("double")).alias("ic_share"))


def stability(ics: DataFrame, order: str) -> DataFrame:
    """One row over a feature's coefficients by period: mean, deviation, ratio, drawdown of their product, positive share."""
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    c = ics.withColumn("__c", F.exp(F.sum(F.ln(F.greatest(1 + F.col("ic"), F.lit(1e-12)))).over(w))).withColumn("__d", F.col("__c") / F.greatest(F.max("__c").over(w), F.lit(0.0)) - 1)
    out = c.agg(F.count("*").alias("periods"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), div(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.min("__d").alias("max_drawdown"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"))
    return out.withColumn("stable", (F.col("icir") > 0.5) & (F.col("max_drawdown") > -0.3))


def _ranked_all(df: DataFrame, by: Sequence[str], x: str, name: str) -> DataFrame:
    """As ``_ranked`` where ``by`` has few values and each of them many rows: no task orders all of a group's values."""
    per = df.groupBy(*by, x).agg(F.count("*").alias("__n"))
    return running_sums(per, by, x, {name: "__n"}).withColumn(name, F.col(name) - (F.col("__n") - 1) / 2).drop("__n", "__next")


def resampled(n: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> float:
    """The rank correlation of as many rows drawn with replacement, ranked anew; n rows have the ordered value x and y (numbered from 0)."""
    total = int(n.sum())
    if total <= 8 * len(n):  # fewer steps row by row than value by value
        w = np.bincount(np.repeat(np.arange(len(n)), n)[rng.integers(0, total, total)], minlength=len(n))
    else:
        w = rng.multinomial(total, n / total)
    return ranked_corr(w, x, y)


def ranked_corr(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """The rank correlation, ties averaged, of rows that have the ordered values x and y w times; NaN without variance."""
    total, r = w.sum(), []
    for v in (x, y):
        each = np.bincount(v, w)
        r.append((np.cumsum(each) - each / 2 - total / 2)[v])  # the mean of the ranks is taken off
    xx, yy, xy = ((w * a * b).sum() for a, b in ((r[0], r[0]), (r[1], r[1]), (r[0], r[1])))
    return float(xy / np.sqrt(xx * yy)) if xx > 0 and yy > 0 else float("nan")


def significances(df: DataFrame, columns: Sequence[str], target: str, replicates: int = 10_000, seed: int = 42, least: int = 30, confidence: float = 0.99, strong: float = 0.05, cells: int = 512) -> DataFrame:
    """(feature, n, ic, ci_low, ci_high, p_value, significant) of each column: rank IC, its bootstrap interval and two-sided p.

    A replicate draws as many rows with replacement and ranks them anew. Rows of about the same two ranks are drawn
    together: ranks fall into ``cells`` steps of equal size on each axis, and what is in one step is a tie. Up to so many
    rows that is the bootstrap of rows exactly; beyond it, a coefficient is less by about its 1 / cells**2 part. So a
    replicate costs at most cells**2 draws, however many rows there are, and replicates are dealt to tasks; they are
    seeded by their number, and the result is the same however rows lie. The IC itself is of the exact ranks. Columns of
    fewer than ``least`` known pairs have no row.
    """
    d = unpivoted(df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(target).cast("double").alias("__y")), ["__y"], columns).select("feature", F.col("value").alias("__x"), "__y").where("__x IS NOT NULL AND __y IS NOT NULL AND NOT isnan(__x) AND NOT isnan(__y)")
    size = d.groupBy("feature").agg(F.count("*").alias("n"))
    r = d.groupBy("feature", "__x", "__y").agg(F.count("*").alias("c"))
    r = r.join(_ranked_all(d, ["feature"], "__x", "rx"), ["feature", "__x"]).join(_ranked_all(d, ["feature"], "__y", "ry"), ["feature", "__y"]).join(F.broadcast(size), "feature").where(F.col("n") >= least)
    mid = lambda k: F.col(k) - (F.col("n") + 1) / 2
    whole = r.groupBy("feature").agg(F.sum("c").alias("n"), div(F.sum(F.col("c") * mid("rx") * mid("ry")), F.sqrt(F.sum(F.col("c") * mid("rx") * mid("rx")) * F.sum(F.col("c") * mid("ry") * mid("ry")))).alias("ic"))
    step = lambda k: F.floor((F.col(k) - 0.5) / F.greatest("n", F.lit(cells)) * cells).cast("int")
    held = r.groupBy("feature", step("rx").alias("x"), step("ry").alias("y")).agg(F.sum("c").alias("c"))
    tasks = max(1, min(16, replicates // 100))

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        (x, y), n = (np.unique(pdf[c], return_inverse=True)[1] for c in ("x", "y")), pdf["c"].to_numpy()
        numbers = range(key[1], replicates, tasks)
        rng = lambda i: np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.blake2b(repr((seed, key[0], i)).encode(), digest_size=16).digest(), "little")))
        return pd.DataFrame({"feature": key[0], "b": [resampled(n, x, y, rng(i)) for i in numbers]})

    every = held.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    boot = every.groupBy("feature", "task").applyInPandas(draw, "feature string, b double").where("NOT isnan(b)")
    tail = (1 - confidence) / 2
    drawn = boot.groupBy("feature").agg(F.percentile("b", tail).alias("ci_low"), F.percentile("b", 1 - tail).alias("ci_high"), F.avg((F.col("b") <= 0).cast("double")).alias("__le"), F.avg((F.col("b") >= 0).cast("double")).alias("__ge"))
    p = F.when(F.col("ic") > 0, F.col("__le")).otherwise(F.col("__ge"))
    got = whole.join(F.broadcast(drawn), "feature").withColumn("p_value", 2 * F.least(p, 1 - p)).drop("__le", "__ge")
    return got.withColumn("significant", (F.abs("ic") > strong) & (F.col("p_value") < 0.01))


def significance(df: DataFrame, feature: str, target: str, **how) -> DataFrame:
    """As ``significances``, of one feature."""
    return significances(df, [feature], target, **how).drop("feature")


def significant_features(df: DataFrame, columns: Sequence[str], target: str, **how) -> list[str]:
    """The significant ones of ``columns``, in their order."""
    kept = {r[0] for r in significances(df, columns, target, **how).where("significant").select("feature").collect()}  # of columns, not rows
    return [c for c in columns if c in kept]


def rolling_ic(df: DataFrame, p: Panel, feature: str, target: str, n: int = 60, share: float = 0.8) -> DataFrame:
    """Rank IC over the n rows before each, if enough of them are known."""
    return rank_corr(df, p, feature, target, n, n * share, "rolling_ic")


# selection


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of every pair, over the rows that know both, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: (F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    one = df.agg(*[div(F.covar_samp(*both(a, b)), F.stddev_samp(both(a, b)[0]) * F.stddev_samp(both(a, b)[1])).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def correlation_filtered(df: DataFrame, columns: Sequence[str], target: str | None = None, limit: float = 0.95) -> list[str]:
    """Columns left after the worse of each highly correlated pair goes: by correlation with the target, else by variance."""
    worth = df.agg(*[(F.abs(div(F.covar_samp(c, target), F.stddev_samp(c) * F.stddev_samp(target))) if target else F.var_samp(c)).alias(c) for c in columns]).first()
    gone: set[str] = set()
    for r in sorted(correlations(df, columns).collect(), key=lambda r: (r["a"], r["b"])):  # of columns, not rows
        if r["corr"] is not None and abs(r["corr"]) > limit and not {r["a"], r["b"]} & gone:
            gone.add(r["a"] if (worth[r["a"]] or 0) < (worth[r["b"]] or 0) else r["b"])
    return [c for c in columns if c not in gone]


def variance_filtered(df: DataFrame, columns: Sequence[str], least: float = 0.01) -> list[str]:
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if (row[c] or 0) >= least]


def missing_filtered(df: DataFrame, columns: Sequence[str], most: float = 0.5) -> list[str]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] <= most]


def f_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, f): F statistic of each column's simple regression, gaps filled by the mean."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    d = df.where(F.col(target).isNotNull()).join(F.broadcast(means), how="cross")  # one row
    x = lambda c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}"))
    one = d.agg(F.count("*").alias("n"), *[div(F.covar_samp(x(c), F.col(target)), F.stddev_samp(x(c)) * F.stddev_samp(target)).alias(c) for c in columns])
    f = lambda r: div(r * r * (F.col("n") - 2), 1 - r * r)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), f(F.col(c)).alias("f")) for c in columns])).alias("r")).select("r.*")


def selected(df: DataFrame, columns: Sequence[str], target: str | None = None, correlation: float = 0.95, variance: float = 0.01, missing: float = 0.5, stability: float | None = None, k: int = 100) -> list[str]:
    """One run of selection: missing values, variance, correlation, stability of a forest's importance (if asked), then the k best.

    The k best have the largest F statistic with the target; without a target, the largest variance.
    """
    left = variance_filtered(df, missing_filtered(df, columns, missing), variance)
    left = correlation_filtered(df, left, target, correlation)
    if target is None:
        worth = df.agg(*[F.var_samp(c).alias(c) for c in left]).first().asDict() if left else {}
    else:
        if stability is not None and left:
            from .model import importance_stability

            firm = importance_stability(df.dropna(subset=[*left, target]), left, target)
            left = [c for c in left if firm[c] >= stability]
        worth = {r["feature"]: r["f"] for r in f_scores(df, left, target).collect()} if left else {}  # of columns, not rows
    best = sorted(left, key=lambda c: (-(worth[c] if worth[c] is not None else -math.inf), c))[:k]
    return [c for c in columns if c in best]


def stability_report(ics: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """(by, periods, ic_mean, ic_std, icir, positive_ratio, trend, grade) of each feature: the trend is the slope over its periods. A coefficient that is zero to twelve places isn't positive."""
    w = Window.partitionBy(*by).orderBy(order)
    out = ics.withColumn("__k", F.row_number().over(w)).groupBy(*by).agg(F.count("ic").alias("periods"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), div(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg((F.round("ic", 12) > 0).cast("double")).alias("positive_ratio"), F.regr_slope("ic", "__k").alias("trend"))
    size = F.abs("icir")
    return out.withColumn("grade", F.when(size > 1, "strong").when(size > 0.5, "stable").when(size > 0.2, "weak").otherwise("unstable"))


def stability_by(df: DataFrame, columns: Sequence[str], target: str, day: str, windows: Sequence[str] = ("M", "Q", "Y"), icir: float = 0.5, drawdown: float = -0.3, least: int = 3) -> DataFrame:
    """(feature, window, periods, ic_mean, ic_std, icir, positive_ratio, max_drawdown, is_stable) of rank ICs by month, quarter and year.

    The drawdown is of the product of 1 + IC over the periods; a feature is stable with an ICIR over ``icir`` and a
    drawdown over ``drawdown``. Figures need two periods of ``least`` known pairs.
    """
    unit = {"M": "month", "Q": "quarter", "Y": "year"}
    d = unpivoted(df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(target).cast("double").alias("__y"), F.col(day).cast("date").alias("__d")), ["__y", "__d"], columns)
    d = d.select("feature", F.col("value").alias("__x"), "__y", F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.trunc("__d", unit[w]).alias("period")) for w in windows])).alias("p")).select("feature", "p.window", "p.period", "__x", "__y").where("__x IS NOT NULL AND __y IS NOT NULL")
    by = ["feature", "window", "period"]
    r = d.join(_ranked_all(d, by, "__x", "rx"), [*by, "__x"]).join(_ranked_all(d, by, "__y", "ry"), [*by, "__y"])
    ics = r.groupBy(*by).agg(F.count("*").alias("n"), div(F.covar_samp("rx", "ry"), F.stddev_samp("rx") * F.stddev_samp("ry")).alias("ic")).where((F.col("n") >= least) & F.col("ic").isNotNull())
    w = Window.partitionBy("feature", "window").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)  # of periods
    ics = ics.withColumn("__c", F.exp(F.sum(F.ln(F.greatest(1 + F.col("ic"), F.lit(1e-12)))).over(w))).withColumn("__f", F.col("__c") / F.max("__c").over(w) - 1)
    out = ics.groupBy("feature", "window").agg(F.count("*").alias("periods"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), div(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg((F.round("ic", 12) > 0).cast("double")).alias("positive_ratio"), F.min("__f").alias("max_drawdown"))
    figures = ("ic_mean", "ic_std", "icir", "positive_ratio", "max_drawdown")
    out = out.withColumns({c: F.when(F.col("periods") > 1, F.col(c)) for c in figures})
    return out.withColumn("is_stable", F.coalesce((F.col("icir") > icir) & (F.col("max_drawdown") > drawdown), F.lit(False)))


def stable_features(df: DataFrame, columns: Sequence[str], target: str, day: str, window: str = "Q", **how) -> list[str]:
    """The stable ones of ``columns`` by one window, in their order."""
    kept = {r["feature"] for r in stability_by(df, columns, target, day, (window,), **how).where("is_stable").collect()}  # of columns, not rows
    return [c for c in columns if c in kept]


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 16) -> DataFrame:
    """(feature, mi): mutual information of quantile bins, from one table of counts for all columns."""
    q = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = df.agg(*[F.percentile_approx(c, q, 10_000).alias(f"__{i}") for i, c in enumerate([*columns, target])])
    d = df.join(F.broadcast(edges), how="cross")  # one row
    at = lambda c, i: F.size(F.filter(F.col(f"__{i}"), lambda e: e < F.col(c)))
    rows = d.select(at(target, len(columns)).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), at(c, i).alias("x"), F.col(c).isNotNull().alias("ok")) for i, c in enumerate(columns)])).alias("r"), F.col(target).isNotNull().alias("oky")).where("r.ok AND oky")
    n = rows.groupBy("r.feature", "r.x", "y").agg(F.count("*").alias("n"))
    f, fx, fy = Window.partitionBy("feature"), Window.partitionBy("feature", "x"), Window.partitionBy("feature", "y")
    n = n.withColumns({"all": F.sum("n").over(f), "nx": F.sum("n").over(fx), "ny": F.sum("n").over(fy)})
    return n.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("mi"))


# signals


def threshold_signals(df: DataFrame, p: str, limit: float = 0.6, risk: float = 1.0, most: float = 1.0) -> DataFrame:
    x = F.col(p)
    return df.withColumns({"signal": F.when(x > limit, 1).when(x < -limit, -1).otherwise(0), "confidence": F.abs(x), "position": F.least(F.abs(x) * risk, F.lit(most))})


def percentile_signals(df: DataFrame, panel: Panel, p: str, n: int = 252, high: float = 0.8, low: float = 0.2) -> DataFrame:
    df = rank_pct(df, panel, {"rank": p}, n)
    return df.withColumns({"signal": F.when(F.col("rank") > high, 1).when(F.col("rank") < low, -1).otherwise(0), "confidence": F.abs(F.col("rank") - 0.5) * 2})


def zscore_signals(df: DataFrame, panel: Panel, p: str, n: int = 252, limit: float = 1.5) -> DataFrame:
    df = df.withColumn("z", panel.zscore(p, n))
    return df.withColumns({"signal": F.when(F.col("z") > limit, 1).when(F.col("z") < -limit, -1).otherwise(0), "confidence": F.least(F.abs("z") / 3, F.lit(1.0))})


def probability_signals(df: DataFrame, p: str, limit: float = 0.2) -> DataFrame:
    x = F.col(p)
    return df.withColumns({"signal": F.when(x > 0.5 + limit / 2, 1).when(x < 0.5 - limit / 2, -1).otherwise(0), "confidence": F.abs(x - 0.5) * 2})


def ensemble_signals(df: DataFrame, models: Sequence[str], limit: float = 0.6) -> DataFrame:
    """Mean of the models' predictions; confidence falls with their (population) deviation."""
    held, n = F.array(*[F.col(m).cast("double") for m in models]), len(models)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("prediction", total(held) / n)
    df = df.withColumn("__s", F.sqrt(total(F.transform(held, lambda x: F.pow(x - F.col("prediction"), 2))) / n))
    return threshold_signals(df, "prediction", limit).withColumn("confidence", 1 / (1 + F.col("__s"))).drop("__s")


def signal_strength(df: DataFrame, panel: Panel) -> DataFrame:
    held = F.abs(F.sum("signal").over(panel.last_n(5)))
    return df.withColumn("strength", F.col("confidence") * F.col("position") * (1 + 0.2 * held / 5))


def risk_controls(df: DataFrame, panel: Panel, ret: str = "ret", floor: float = -0.2, target: float = 0.15, n: int = 20) -> DataFrame:
    """Signals held back while the strategy is in a deep drawdown, and scaled to a target volatility."""
    df = df.withColumn("strategy_ret", F.coalesce(F.col(ret) * panel.lag("signal"), F.lit(0.0)))
    df = df.withColumn("__c", panel.growth("strategy_ret"))
    df = df.withColumns({"drawdown": F.col("__c") / F.max("__c").over(panel.so_far) - 1, "__v": panel.std("strategy_ret", n) * math.sqrt(252)})
    return df.withColumn("controlled", F.when(F.col("drawdown") < floor, 0.0).otherwise(F.col("signal") * F.least(F.coalesce(div(F.lit(target), "__v"), F.lit(1.0)), F.lit(1.0)))).drop("__c", "__v")


def portfolio(df: DataFrame, time: str, weights: DataFrame | None = None, asset: str = "secu") -> DataFrame:
    """(time, position): weighted sum of the assets' signals (equal weights by default), in [-1, 1]."""
    if weights is None:
        n = df.agg(F.countDistinct(asset).alias("__n"))
        df = df.join(F.broadcast(n), how="cross").withColumn("weight", 1 / F.col("__n"))  # one row
    else:
        df = df.join(weights, asset)
    return df.groupBy(time).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(F.col("weight") * F.col("signal")))).alias("position"))


def signal_statistics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("signal") == 1).alias("buys"), F.count_if(F.col("signal") == -1).alias("sells"), F.count_if(F.col("signal") == 0).alias("holds"), F.avg("confidence").alias("mean_confidence"))


# back-test


def curve(df: DataFrame, panel: Panel, ret: str = "ret") -> DataFrame:
    """Adds the cumulative product and the drawdown."""
    df = df.withColumn("cum", panel.growth(ret))
    return df.withColumn("drawdown", F.col("cum") / F.max("cum").over(panel.so_far) - 1)


def performance(df: DataFrame, panel: Panel, ret: str = "ret", benchmark: str | None = None, risk_free: float = 0.03) -> DataFrame:
    """One row a series: returns, volatility, Sharpe, Sortino, Calmar, drawdown, wins, losses in a row, and against a benchmark."""
    d = curve(df.where(F.col(ret).isNotNull()), panel, ret)
    r, at = F.col(ret), F.struct(*panel.time)
    runs = loss_runs(d, panel, ret).groupBy(*panel.by).agg(F.max("length").alias("max_consecutive_losses"))
    aggs = [F.count("*").alias("n"), (F.max_by("cum", at) - 1).alias("total_return"), (F.stddev_samp(r) * math.sqrt(252)).alias("volatility"), (F.stddev_samp(F.when(r < 0, r)) * math.sqrt(252)).alias("__down"), F.min("drawdown").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("win_rate"), F.abs(div(F.avg(F.when(r > 0, r)), F.avg(F.when(r < 0, r)))).alias("profit_factor")]
    if benchmark:
        b = F.col(benchmark)
        aggs += [div(F.covar_samp(r, b), F.var_samp(b)).alias("beta"), div(F.avg(r - b) * math.sqrt(252), F.stddev_samp(r - b)).alias("information_ratio"), F.avg(b).alias("__b"), F.avg(r).alias("__r")]
    out = d.groupBy(*panel.by).agg(*aggs).join(runs, list(panel.by), "left").withColumn("max_consecutive_losses", F.coalesce("max_consecutive_losses", F.lit(0)))
    out = out.withColumn("annual_return", F.pow(1 + F.col("total_return"), 252 / F.col("n")) - 1)
    out = out.withColumns({"sharpe": div(F.col("annual_return") - risk_free, "volatility"), "sortino": div(F.col("annual_return") - risk_free, "__down"), "calmar": div("annual_return", F.abs("max_drawdown"))}).drop("__down")
    return out.withColumn("alpha", F.col("__r") * 252 - (risk_free + F.col("beta") * (F.col("__b") * 252 - risk_free))).drop("__b", "__r") if benchmark else out


def _islands(df: DataFrame, panel: Panel, is_in: Column) -> DataFrame:
    """Rows for which ``is_in`` holds, with the number of their run in ``__run``."""
    f = F.coalesce(is_in, F.lit(False)).cast("int")
    return df.withColumn("__run", F.row_number().over(panel.w) - F.sum(f).over(panel.so_far)).where(f == 1)


def loss_runs(df: DataFrame, panel: Panel, ret: str = "ret") -> DataFrame:
    """(by, start, end, length) of runs of losses."""
    t = panel.time[0]
    return _islands(df, panel, F.col(ret) < 0).groupBy(*panel.by, "__run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("length")).drop("__run")


def drawdowns(df: DataFrame, panel: Panel, ret: str = "ret") -> DataFrame:
    """(by, start, end, rows, depth, recovered) of the periods under water."""
    t = panel.time[0]
    d = curve(df.where(F.col(ret).isNotNull()), panel, ret).withColumn("__last", F.max(t).over(panel.whole))
    got = _islands(d, panel, F.col("drawdown") < 0).groupBy(*panel.by, "__run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("length"), F.min("drawdown").alias("depth"), F.max("__last").alias("__last"))
    return got.withColumn("recovered", (F.col("end") < F.col("__last")).cast("int")).drop("__run", "__last")


def risk(df: DataFrame, panel: Panel, ret: str = "ret", n: int = 20) -> DataFrame:
    """VaR and CVaR at 95 and 99, skewness, excess kurtosis (population), tail deviation, clustering of volatility."""
    d = df.where(F.col(ret).isNotNull()).withColumn("__v", panel.std(ret, n)).withColumn("__u", panel.lag("__v"))
    q = d.groupBy(*panel.by).agg(F.percentile(ret, 0.05).alias("var_95"), F.percentile(ret, 0.01).alias("var_99"))
    r = F.col(ret)
    both = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a))
    return d.join(q, list(panel.by)).groupBy(*panel.by).agg(
        F.first("var_95").alias("var_95"), F.first("var_99").alias("var_99"), F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"), F.avg(F.when(r <= F.col("var_99"), r)).alias("cvar_99"),
        F.skewness(r).alias("skewness"), F.kurtosis(r).alias("kurtosis"), F.stddev_samp(F.when(r < F.col("var_99"), r)).alias("tail_risk"),
        div(F.covar_samp(both("__v", "__u"), both("__u", "__v")), F.stddev_samp(both("__v", "__u")) * F.stddev_samp(both("__u", "__v"))).alias("vol_clustering"),
    )


def turnover(df: DataFrame, panel: Panel, position: str = "signal", cost: float = 0.001) -> DataFrame:
    """Mean change of position, mean length of a holding, cost."""
    d = df.withColumn("__c", F.coalesce(F.abs(panel.diff(position)), F.lit(0.0)))
    runs = _islands(d.withColumn("__new", F.sum((F.col("__c") > 0).cast("int")).over(panel.so_far)), panel, F.col(position) != 0)
    held = runs.groupBy(*panel.by, "__new").agg(F.count("*").alias("__n")).groupBy(*panel.by).agg(F.avg("__n").alias("mean_holding"))
    return d.groupBy(*panel.by).agg(F.avg("__c").alias("turnover"), (F.sum("__c") * cost).alias("total_cost")).join(held, list(panel.by), "left")


def rolling_metrics(df: DataFrame, panel: Panel, ret: str = "ret", n: int = 252, risk_free: float = 0.03) -> DataFrame:
    """Return, volatility, Sharpe and drawdown within the last n rows."""
    df = df.withColumn("__l", F.ln(1 + F.col(ret)))
    df = df.withColumns({"rolling_return": F.exp(panel.total("__l", n)) - 1, "rolling_volatility": panel.std(ret, n) * math.sqrt(252)})
    df = df.withColumn("rolling_sharpe", div(F.col("rolling_return") - risk_free * n / 252, F.col("rolling_volatility") * math.sqrt(n / 252))).drop("__l")
    return rolling_drawdown(df, panel, ret, n, "rolling_drawdown")


def backtest(df: DataFrame, panel: Panel, prediction: str, realised: str, mode: str = "sign") -> DataFrame:
    """Performance of holding by the prediction's sign; with ``mode="reference"`` predictions count as returns themselves."""
    r = F.col(prediction) if mode == "reference" else F.col(realised) * F.signum(prediction)
    return performance(df.withColumn("ret", r), panel)
