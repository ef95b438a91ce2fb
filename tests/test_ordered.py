"""Sums in order without one sorting task, calendars by day, the bootstrap, model drift."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import by_day, running_sums
from tidemark.functions.panel import Panel, ema
from tidemark.operators import drift, joins, opening, research


def test_running_sums_over_buckets(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(x), int(n)) for k, size in (("a", 500), ("b", 3), ("c", 1)) for x, n in zip(rng.permutation(size) * 0.5, rng.integers(0, 9, size), strict=True)]
    for buckets in (1, 2, 7, 64):
        got = {(r["k"], r["x"]): (r["up"], r["__next"]) for r in running_sums(spark.createDataFrame(rows, "k string, x double, n long"), ["k"], "x", {"up": "n"}, buckets).collect()}
        for k in "abc":
            own = sorted((x, n) for key, x, n in rows if key == k)
            total = np.cumsum([n for _, n in own])
            assert [got[k, x] for x, _ in own] == list(zip(total, [x for x, _ in own[1:]] + [None], strict=True))


def test_days_of_a_calendar(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3, 5, 9)] + [(None,)], "day date")
    dates = [dt.date(2023, 5, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 4), dt.date(2024, 1, 9), dt.date(2025, 1, 1), None]
    q = spark.createDataFrame([(d,) for d in dates], "d date")
    got = {r.d: (r.at and r.at.day, r.before and r.before.day, r.after and r.after.day, r.number) for r in by_day(q, "d", days, "day", ["at", "before", "after", "number"]).collect()}
    assert [got[d] for d in dates] == [(None, None, 2, 0), (2, None, 3, 1), (3, 3, 5, 2), (9, 5, None, 4), (9, 9, None, 4), (None, None, None, None)]
    assert by_day(q, "d", days.limit(0), "day", ["at", "number"]).where("number = 0 and at is null").count() == 6
    plan = joins.between_ordinals(q.withColumn("e", F.date_add("d", 9)), days, "d", "e")
    assert [r.trading_days for r in plan.orderBy("d").collect()] == [0, 0, 4, 2, 1, 0]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "__one" not in text and "BroadcastHashJoin" in text


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y, z = 0.4 * x + rng.normal(size=400), rng.normal(size=400)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, z, y, strict=True)] + [(None, 1.0, 1.0), (1.0, None, None)]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    got = {r.feature: r for r in research.significances(df, ["x", "z"], "y", replicates=2000).collect()}
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    rx, ry = rank(x), rank(y)
    assert got["x"].ic == pytest.approx(np.corrcoef(rx, ry)[0, 1]) and got["x"].n == 400
    drawn = [np.corrcoef(rx[i], ry[i])[0, 1] for i in (rng.integers(0, 400, 400) for _ in range(2000))]
    assert got["x"].ci_low == pytest.approx(np.percentile(drawn, 0.5), abs=0.03) and got["x"].ci_high == pytest.approx(np.percentile(drawn, 99.5), abs=0.03)
    assert got["x"].significant and not got["z"].significant and got["z"].p_value > 0.01
    again = {r.feature: r for r in research.significances(df.repartition(7), ["x", "z"], "y", replicates=2000).collect()}
    assert again["x"].ci_low == pytest.approx(got["x"].ci_low, abs=1e-9)
    assert research.significant_features(df, ["z", "x"], "y", replicates=2000) == ["x"]


def test_either_since_and_noise(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 3, 3), (3, None, 2), (4, 5, None)], "k int, a int, b int")
    got = joins.either(df, ["a", "b"], spark.createDataFrame([(2,), (3,), (3,), (None,)], "v int"), "v")
    assert sorted(r.k for r in got.collect()) == [1, 2, 3]
    u = [r[0] for r in df.select(opening.noise(["k"])).collect()]
    assert all(-1 <= v < 1 for v in u) and len(set(u)) == 4


def test_fall_of_a_models_score(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    make = lambda sign: spark.createDataFrame([(float(a), float(sign * 2 * a)) for a in x], "x double, target double")
    assert drift.score_drop(make(1), make(1), ["x"], "target").first().drifted is False
    assert drift.score_drop(make(1), make(-1), ["x"], "target").first().drifted is True


@pytest.mark.parametrize("adjust", [False, True])
def test_exponential_means_over_batches_equal_pandas(spark, adjust):
    rng = np.random.default_rng(7)
    rows = [(k, t, None if rng.random() < 0.3 else float(rng.normal())) for k, n in (("a", 40), (None, 25), ("b", 1), ("c", 11)) for t in range(n)]
    rows += [("d", t, None) for t in range(9)] + [("d", 20, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(r.k, r.t): r for r in ema(df, Panel(("k",), ("t",)), {"f": ("x", 3), "s": ("x", 9), "m": (("f", "s"), 4)}, adjust).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        own = pd.Series([x for key, _, x in rows if key == k], dtype=float)
        mean = lambda x, n: x.ewm(span=n, adjust=adjust).mean()
        f, s = mean(own, 3), mean(own, 9)
        for name, want in (("f", f), ("s", s), ("m", mean(f - s, 4))):
            have = pd.Series([getattr(got[k, t], name) for key, t, _ in rows if key == k], dtype=float)
            pd.testing.assert_series_equal(have, want, check_names=False, rtol=1e-9)


def test_rows_of_a_model_are_computed_once(spark):
    """However often a fit, an elimination or a comparison reads them."""
    import random

    from tidemark.operators import model

    rng, seen = random.Random(2), spark.sparkContext.accumulator(0)
    rows = [(a, b, c, 2 * a - b + 0.01 * c) for a, b, c in ([rng.gauss(0, 1) for _ in range(3)] for _ in range(60))]

    def told(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    schema = "a double, b double, c double, target double"
    df, later = (spark.createDataFrame(r, schema).mapInPandas(told, schema) for r in (rows, rows[:30]))
    model.fitted(df, ["a", "b", "c"], "ridge")
    assert seen.value == 60
    assert model.eliminated(df, ["a", "b", "c"], 1) == ["a"] and seen.value == 120
    got = drift.score_drop(df, later, ["a", "b", "c"], "target").first()
    assert got.before > 0.9 and got.after > 0.9 and seen.value == 210


def test_both_periods_of_a_score_drop_come_from_rows_computed_once(spark, monkeypatch):
    import random

    from tidemark.queries import audit, models

    rng, seen = random.Random(3), spark.sparkContext.accumulator(0)
    rows = []
    for i in range(120):
        x = [rng.gauss(0, 1) for _ in models.FEATURES]
        rows.append((dt.date(1997 + i % 2, 1 + i % 12, 1 + i % 28), *x, sum(x) * (1 if i % 2 == 0 else -1)))
    schema = ", ".join(["d date", *(f"{c} double" for c in models.FEATURES), "target double"])

    def told(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    monkeypatch.setattr(models, "frame", lambda spark, sf: spark.createDataFrame(rows, schema).mapInPandas(told, schema))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = audit.score_drop(spark, "").first()
    assert seen.value == len(rows) and spark.sparkContext._jsc.getPersistentRDDs().size() == held
    plain = spark.createDataFrame(rows, schema)
    want = drift.score_drop(plain.where("year(d) < 1998"), plain.where("year(d) >= 1998"), models.FEATURES, "target").first()
    assert (got.before, got.after, got.fall) == pytest.approx((want.before, want.after, want.fall), abs=1e-4) and got.drifted is want.drifted is True
