"""Fills from the end, marks of days, column kinds, imputation by share, scores against the library's evaluators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel
from tidemark.operators import clean, joins, market, model, quality

T = Panel(("k",), ("t",))


def day(n):
    return dt.date(2024, 1, n)


def test_backward_fill_reads_each_row_once(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 999, F.col("id").cast("double")).alias("x"))
    got = clean.filled(df, T, ["x"], "bfill")
    assert got.where("x = (t div 1000) * 1000 + 999").count() == n
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString()
    line = clean.filled(df, T, ["x"], "interpolate").where("t >= 999")
    assert "unboundedfollowing" not in line._jdf.queryExecution().executedPlan().toString()
    assert line.where("abs(x - t) > 1e-9").count() == 0


def test_fills_keep_series_apart_and_edges_empty(spark):
    rows = [("a", 1, None), ("a", 2, 4.0), ("a", 3, None), ("b", 1, None), ("b", 2, None), (None, 1, 7.0), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    back = {(r.k, r.t): r.x for r in clean.filled(df, T, ["x"], "bfill").collect()}
    assert back == {("a", 1): 4.0, ("a", 2): 4.0, ("a", 3): None, ("b", 1): None, ("b", 2): None, (None, 1): 7.0, (None, 2): None}
    line = {(r.k, r.t): r.x for r in clean.filled(df, T, ["x"], "interpolate").collect()}
    assert line == {("a", 1): None, ("a", 2): 4.0, ("a", 3): 4.0, ("b", 1): None, ("b", 2): None, (None, 1): 7.0, (None, 2): 7.0}
    grid = joins.aligned(df.where("k IS NOT NULL"), "k", "t", ["x"], "bfill")
    assert grid.count() == 6 and grid.where("k = 'a' AND x = 4").count() == 2


def test_marks_never_multiply_rows(spark):
    q = spark.createDataFrame([("a", day(1)), ("a", day(2)), ("a", day(2)), ("b", day(1)), (None, day(1)), ("a", None)], "secu string, d date")
    susp = spark.createDataFrame([("a", day(1), day(2)), ("a", day(1), None), ("b", None, None), (None, day(1), day(1))], "secu string, SuspendDate date, ResumptionDate date")
    factors = spark.createDataFrame([("a", day(2)), ("a", day(2))], "secu string, ExDiviDate date")
    got = sorted(((r.secu or "", str(r.d), r.suspended_on, r.resumed_on, r.factor_changed) for r in market.day_marks(q, susp, factors, "secu", "d").collect()))
    assert got == [("", "2024-01-01", False, False, False), ("a", "2024-01-01", True, False, False), ("a", "2024-01-02", False, True, True), ("a", "2024-01-02", False, True, True), ("a", "None", False, False, False), ("b", "2024-01-01", False, False, False)]
    none = market.day_marks(q, susp.limit(0), factors.limit(0), "secu", "d")
    assert none.count() == 6 and none.where("suspended_on OR resumed_on OR factor_changed").count() == 0


def test_review_of_changes(spark):
    rows = [(day(1), 9.8, True), (day(1), -1.0, False), (day(2), None, True), (day(2), 0.0, None), (None, 5.0, True)]
    df = spark.createDataFrame(rows, "d date, x double, resumed_on boolean")
    got = {(r.scope, r.month): r for r in market.change_review(df, "d", "x").collect()}
    assert set(got) == {("all", None), ("all", day(1)), ("resumed", None), ("resumed", day(1))}
    assert (got["all", None].n, got["all", None].valid, got["all", None].limit_up, got["all", None].unchanged, got["all", None].small) == (4, 3, 1, 1, 2)
    assert (got["resumed", None].n, got["resumed", None].valid, got["resumed", None].high, got["resumed", None].std) == (2, 1, 1, None)
    assert market.change_review(df.limit(0), "d", "x").count() == 0
    marked = df.withColumns({"suspended_on": F.lit(False), "factor_changed": F.lit(True)}).where("x > 8")
    assert [r.told for r in market.large_moves(marked, "x").collect()] == ["resumed_on,factor_changed"]


def test_kinds_of_columns(spark):
    rows = [(1.0, 1.0, 2.5, "a", "a", 1), (2.0, None, 3.0, "a", "b", 2), (3.0, 3.0, 4.0, "a", "c", 3)]
    df = spark.createDataFrame(rows, "whole double, gap double, part double, few string, many string, n int")
    assert {r.column_name: r.kind for r in clean.column_types(df).collect()} == {"whole": "integer", "gap": "as it is", "part": "as it is", "few": "category", "many": "as it is", "n": "as it is"}
    assert {r.kind for r in clean.column_types(df.limit(0)).collect()} == {"as it is"}
    odd = df.withColumns({"inf": F.lit(float("inf")), "nan": F.lit(float("nan")), "huge": F.lit(1e300)})
    assert [t for _, t in clean.integers(odd).dtypes] == ["bigint", "double", "double", "string", "string", "int", "double", "double", "double"]
    assert clean.integers(df.limit(0)).dtypes == df.dtypes


@pytest.mark.parametrize(("every", "how"), [(100, "simple"), (10, "interpolation"), (3, "knn")])
def test_imputation_follows_the_share(spark, every, how):
    df = spark.range(300).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % every != 1, F.col("id") * 1.0).alias("x"))
    got = clean.auto_imputed(df, T, ["x"])
    assert clean.strategy(1 / every) == how
    assert got.where("x IS NULL").count() == 0
    want = {"simple": clean.imputed(df, ["x"], "mean"), "interpolation": clean.filled(df, T, ["x"], "interpolate"), "knn": clean.knn_imputed(df, ("k",), ["x"])}[how]
    assert sorted(got.select("t", "x").collect()) == sorted(want.select("t", "x").collect())
    assert clean.auto_imputed(df.limit(0), T, ["x"]).count() == 0


def test_scores_equal_the_evaluators(spark):
    rng = np.random.default_rng(5)
    rows = [(float(y), float(y if rng.random() < 0.7 else 1 - y)) for y in rng.integers(0, 2, 500)]
    df = spark.createDataFrame(rows, "target double, prediction double")
    one, given = model.class_scores(df).first(), model.classification_metrics(df)
    for ours, theirs in (("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall"), ("weighted_f1", "f1"), ("auc", "auc")):
        assert one[ours] == pytest.approx(given[theirs], abs=1e-12)
    lines = spark.createDataFrame([(float(a), float(a + b)) for a, b in rng.normal(size=(400, 2))], "target double, prediction double")
    ours, given = model.regression_scores(lines).first(), model.regression_metrics(lines)
    assert all(ours[m] == pytest.approx(given[m], abs=1e-12) for m in ("mse", "mae", "rmse", "r2"))
    alone = spark.createDataFrame([(1.0, 1.0), (1.0, None), (None, 1.0)], "target double, prediction double")
    assert model.class_scores(alone).first().n == 1 and model.class_scores(alone).first().auc is None and model.regression_scores(alone).first().r2 is None


def test_reports_of_issues(spark):
    rows = [("a", 1, "c: null; v: zero"), ("a", 2, "c: negative"), ("b", 1, "c: null"), ("b", 2, ""), ("c", 3, None)]
    df = spark.createDataFrame(rows, "s string, n int, Issues string")
    assert sorted(map(tuple, quality.issues_by_age(df, "n").collect())) == [(1, 2, 3), (2, 1, 1)]
    assert [tuple(r) for r in quality.most_issues(df, "s", 1).collect()] == [("a", 2, 2)]
    assert quality.most_issues(df.limit(0), "s").count() == 0
    q = spark.createDataFrame([(None, 0.0, None), (-1.0, 0.0, False), (0.0, 5.0, True), (-2.0, 0.0, True)], "p double, v double, susp boolean")
    got = {r.field: r for r in quality.field_issues(q, ["p"], ["v"], F.col("susp")).collect()}
    assert (got["p"].nulls, got["p"].zeros, got["p"].placeholders, got["p"].negatives, got["p"].nulls_pct) == (1, 1, 1, 2, 25.0)
    assert (got["v"].zeros, got["v"].rows) == (2, 4)


def test_described_quantiles_are_exact_and_in_no_one_buffer(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"x": rng.normal(size=2003), "few": rng.integers(0, 4, 2003).astype(float), "same": 7.5})
    pdf.loc[rng.random(2003) < 0.1, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "x double, few double, same double").withColumn("none", F.lit(None).cast("double")).repartition(5)
    names = ["x", "few", "same", "none"]
    for d in (quality.described(df, names), quality.consistency(df, names)):
        assert "percentile(" not in d._jdf.queryExecution().executedPlan().toString()
    got = {r.column_name: r for r in quality.described(df, names).collect()}
    for c in names[:3]:
        want = pdf[c].quantile([0.25, 0.5, 0.75])
        np.testing.assert_allclose([got[c].q25, got[c].median, got[c].q75], want, rtol=1e-12)
        assert got[c]["count"] == pdf[c].count() and got[c].max == pdf[c].max()
    assert got["none"]["count"] == 0 and got["none"].median is None
    found = {r.column_name: r.outliers for r in quality.consistency(df, names).collect()}
    q = pdf.x.quantile([0.25, 0.75]).tolist()
    assert found == {"x": int(((pdf.x < q[0] - 1.5 * (q[1] - q[0])) | (pdf.x > q[1] + 1.5 * (q[1] - q[0]))).sum()), "few": 0, "same": 0, "none": 0}
