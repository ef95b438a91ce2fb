"""Targets, regressions, ensembles, time-series validation, elimination."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.panel import Panel, div


def with_target(df: DataFrame, p: Panel, price: str, horizon: int = 5, name: str = "target", classify: bool = False) -> DataFrame:
    """Return over the next ``horizon`` rows, or whether it is positive (unknown counts as not)."""
    y = div(p.lead(price, horizon), price) - 1
    return df.withColumn(name, F.coalesce(y > 0, F.lit(False)).cast("double") if classify else y)


def _stages(features: Sequence[str], last) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__raw", handleInvalid="skip"), StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True), last])


def estimator(kind: str, target: str = "target", trees: int = 100, seed: int = 42, alpha: float | None = None, n: int = 1):
    """linear, ridge, lasso, forest, boosted; forest_class, boosted_class. Ridge's alpha is per all rows, lasso's per row."""
    common = {"featuresCol": "features", "labelCol": target}
    made = {
        "linear": lambda: LinearRegression(**common), "ridge": lambda: LinearRegression(**common, regParam=(1.0 if alpha is None else alpha) / max(1, n), elasticNetParam=0.0),
        "lasso": lambda: LinearRegression(**common, regParam=0.01 if alpha is None else alpha, elasticNetParam=1.0),
        "forest": lambda: RandomForestRegressor(**common, numTrees=trees, seed=seed), "boosted": lambda: GBTRegressor(**common, maxIter=trees, seed=seed),
        "forest_class": lambda: RandomForestClassifier(**common, numTrees=trees, seed=seed), "boosted_class": lambda: GBTClassifier(**common, maxIter=trees, seed=seed),
    }
    return made[kind]()


@contextmanager
def kept(df: DataFrame, columns: Sequence[str]):
    """These columns of ``df``, computed once for all that is done with them, in executors' memory and on their disks."""
    d = df.select(*dict.fromkeys(columns)).persist()
    try:
        yield d
    finally:
        d.unpersist()


def fitted(df: DataFrame, features: Sequence[str], kind: str = "linear", target: str = "target", **how) -> PipelineModel:
    """A fit reads the rows several times; they are computed once."""
    with kept(df.dropna(subset=[*features, target]), [*features, target]) as d:
        if kind == "ridge":
            how["n"] = d.count()
        return _stages(features, estimator(kind, target, **how)).fit(d)


def importance(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """Size of the coefficients, or the trees' importance."""
    last = model.stages[-1]
    values = [abs(x) for x in last.coefficients] if hasattr(last, "coefficients") else list(last.featureImportances.toArray())
    return dict(zip(features, map(float, values), strict=True))


def regression_metrics(scored: DataFrame, target: str = "target") -> dict[str, float]:
    return {m: RegressionEvaluator(labelCol=target, metricName=m).evaluate(scored) for m in ("mse", "mae", "rmse", "r2")}


def classification_metrics(scored: DataFrame, target: str = "target") -> dict[str, float]:
    out = {m: MulticlassClassificationEvaluator(labelCol=target, metricName=m).evaluate(scored) for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")}
    return out | {"auc": BinaryClassificationEvaluator(labelCol=target, rawPredictionCol="prediction").evaluate(scored)}


def regression_scores(scored: DataFrame, by: Sequence[str] = (), target: str = "target", prediction: str = "prediction") -> DataFrame:
    """(by, n, mse, mae, rmse, r2) in one aggregation; rows without target or prediction don't count, r2 is NULL without variance."""
    y, e = F.col(target), F.col(target) - F.col(prediction)
    d = scored.where(e.isNotNull())
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("__v"))
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": 1 - div("mse", "__v")}).drop("__v")


def class_scores(scored: DataFrame, by: Sequence[str] = (), target: str = "target", prediction: str = "prediction") -> DataFrame:
    """(by, n, accuracy, weighted_precision, weighted_recall, weighted_f1, auc) of labels 0 and 1, from one count of the four cases.

    Rows without label or prediction don't count. A class that is never predicted has a precision of 0; the area under
    the curve is that of hard predictions, NULL where a class has no rows.
    """
    y, p = F.col(target), F.col(prediction)
    cell = lambda a, b: F.count_if((y == a) & (p == b))
    d = scored.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), cell(1, 1).alias("__tp"), cell(0, 0).alias("__tn"), cell(0, 1).alias("__fp"), cell(1, 0).alias("__fn"))
    tp, tn, fp, fn = (F.col(f"__{c}").cast("double") for c in ("tp", "tn", "fp", "fn"))
    part = lambda hit, of: F.coalesce(div(hit, of), F.lit(0.0))
    pos, neg = part(tp, tp + fp), part(tn, tn + fn)
    caught, spared = part(tp, tp + fn), part(tn, tn + fp)
    f = lambda a, b: part(2 * a * b, a + b)
    weighted = lambda a, b: div(a * (tp + fn) + b * (tn + fp), "n")
    auc = F.when((tp + fn > 0) & (tn + fp > 0), (caught + spared) / 2)
    return d.select(*by, "n", div(tp + tn, "n").alias("accuracy"), weighted(pos, neg).alias("weighted_precision"), weighted(caught, spared).alias("weighted_recall"), weighted(f(pos, caught), f(neg, spared)).alias("weighted_f1"), auc.alias("auc"))


def time_folds(df: DataFrame, time: str, k: int = 5) -> DataFrame:
    """``df`` with ``fold`` by the distinct dates' order: 0 trains only, fold i is tested on all that comes before it.

    Dates are few beside rows; only they are numbered in one sequence.
    """
    days = df.select(time).distinct()
    days = days.withColumn("__n", F.ntile(k + 1).over(Window.partitionBy(F.lit(0)).orderBy(time)) - 1)
    return df.join(F.broadcast(days) if days.count() <= 100_000 else days, time).withColumnRenamed("__n", "fold")


def cross_validated(df: DataFrame, features: Sequence[str], time: str, kind: str = "linear", target: str = "target", k: int = 5, **how) -> list[dict[str, float]]:
    """Metrics of each test fold of expanding training sets."""
    d = time_folds(df.dropna(subset=[*features, target]), time, k).persist()
    out = []
    for i in range(1, k + 1):
        model = fitted(d.where(F.col("fold") < i), features, kind, target, **how)
        out.append(regression_metrics(model.transform(d.where(F.col("fold") == i)), target))
    d.unpersist()
    return out


def eliminated(df: DataFrame, features: Sequence[str], keep: int, kind: str = "ridge", target: str = "target", **how) -> list[str]:
    """Recursive elimination: the least important feature goes until ``keep`` are left."""
    left = list(features)
    with kept(df, [*features, target]) as d:
        while len(left) > keep:
            worth = importance(fitted(d, left, kind, target, **how), left)
            left.remove(min(left, key=lambda c: (worth[c], c)))
    return left


def importance_stability(df: DataFrame, features: Sequence[str], target: str = "target", splits: int = 5, trees: int = 20, seed: int = 42) -> dict[str, float]:
    """Mean over deviation of each feature's forest importance on random halves."""
    import numpy as np

    with kept(df, [*features, target]) as d:
        rows = [list(importance(fitted(d.where(F.pmod(F.xxhash64(*features, F.lit(seed + i)), F.lit(2)) == 0), features, "forest", target, trees=trees, seed=seed), features).values()) for i in range(splits)]
    x = np.array(rows)
    return dict(zip(features, map(float, x.mean(0) / (x.std(0) + 1e-12)), strict=True))


def saved(model: PipelineModel, path: str) -> str:
    """Write a model to any file system that Spark can write to."""
    model.write().overwrite().save(path)
    return path


def loaded(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def summary(spark, model: PipelineModel, features: Sequence[str]):
    """(feature, importance, share) of a fitted model, the largest first in ``rank``."""
    worth = importance(model, features)
    total = sum(worth.values()) or 1.0
    order = sorted(worth, key=lambda c: (-worth[c], c))
    return spark.createDataFrame([(c, worth[c], worth[c] / total, order.index(c) + 1) for c in features], "feature string, importance double, share double, rank int")
