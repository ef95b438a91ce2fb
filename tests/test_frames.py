"""Joins, calendars, cleaning, drift, storage, streams and statistics."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel
from tidemark.operators import alternative, clean, drift, joins, quality, research, timeseries
from tidemark.sources import tables
from tidemark.streaming import incremental

P = Panel(("k",), ("t",))


def test_asof_equals_merge_asof(spark):
    r = np.random.default_rng(0)
    left = pd.DataFrame({"k": r.integers(0, 5, 200), "t": r.integers(0, 100, 200), "x": r.normal(size=200)})
    right = pd.DataFrame({"k": r.integers(0, 5, 40), "t": r.integers(0, 100, 40), "f": r.normal(size=40)}).drop_duplicates(["k", "t"])
    got = joins.asof(spark.createDataFrame(left), spark.createDataFrame(right.rename(columns={"t": "s"})), ["k"], "t", "s", ["f"], {"f": 1.0}).toPandas()
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k")
    want["f"] = want.f.fillna(1.0)
    order = ["k", "t", "x"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True)[["k", "t", "x", "f"]], want.sort_values(order).reset_index(drop=True)[["k", "t", "x", "f"]], check_dtype=False)


def test_interpolation_and_fills(spark):
    x = [None, 1.0, None, None, 4.0, None, 7.0, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, t int, x double")
    at = lambda d: [r.x for r in d.orderBy("t").collect()]
    assert at(joins.interpolated(df, ["k"], ["t"], ["x"])) == [None, 1.0, 2.0, 3.0, 4.0, 5.5, 7.0, 7.0]
    assert at(clean.filled(df, P, ["x"], "ffill", 1)) == [None, 1.0, 1.0, None, 4.0, 4.0, 7.0, 7.0]
    assert at(clean.missing_handled(df, P, ["x"])) == [1.0, 1.0, 1.0, 1.0, 4.0, 4.0, 7.0, 7.0]
    assert at(clean.interpolation_imputed(df, P, ["x"], "polynomial", 1)) == pytest.approx([1, 1, 2, 3, 4, 5.5, 7, 7])


def test_calendar(spark):
    days = timeseries.trading_days(spark, "2024-01-01", "2024-01-31", spark.sql("SELECT DATE'2024-01-01' AS day"))
    assert days.count() == 22
    q = spark.sql("SELECT explode(array(DATE'2024-01-01', DATE'2024-01-05', DATE'2024-01-06')) AS d")
    got = {r.d.day: (r.is_trading_day, r.previous_trading_day, r.next_trading_day) for r in timeseries.neighbours(q, days, "d").collect()}
    d = lambda k: dt.date(2024, 1, k)
    assert got == {1: (0, None, d(2)), 5: (1, d(4), d(8)), 6: (0, d(5), d(8))}


def test_cleaning(spark):
    df = spark.createDataFrame([(1.0, None, "2024-01-01"), (1.0, None, "2024-01-01"), (2.0, None, "x"), (None, None, None)], "price double, none string, day string")
    got = clean.cleaned(df)
    assert got.columns == ["price", "day"] and sorted((r.price, str(r.day)) for r in got.collect()) == [(1.0, "2024-01-01"), (2.0, "None")]
    wild = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "x double")
    assert [r.x for r in clean.outliers_removed(wild, ["x"], "iqr", 1.5).collect()][-1] is None
    assert clean.integral(wild) == ["x"]
    knn = clean.knn_imputed(spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, None), ("a", 3.0, 30.0)], "k string, x double, y double"), ["k"], ["x", "y"], 2)
    assert {r.x: r.y for r in knn.collect()}[2.0] == 20.0


def test_drift_of_a_table_with_itself_is_none(spark):
    df = spark.range(500).select((F.col("id") * 7 % 101).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("y"))
    same = drift.ks(df, df, ["x"]).first()
    assert same.statistic == 0 and not same.drifted and drift.wasserstein(df, df, ["x"]).first().distance == 0
    moved = df.select((F.col("x") + 40).alias("x"), "y")
    assert drift.ks(df, moved, ["x"]).first().drifted and drift.chi2(df, moved, ["x"]).first().drifted
    assert drift.wasserstein(df, moved, ["x"]).first().distance == pytest.approx(40)
    assert drift.covariate(df, moved, ["x", "y"], 2).first().score > 0.4


def test_rank_ic_and_performance(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.repeat([0, 1], 60), "x": r.integers(0, 9, 120).astype(float), "y": r.normal(size=120)})
    got = {x.g: x.ic for x in research.rank_ic(spark.createDataFrame(pdf), ["g"], "x", "y").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part.x.rank().corr(part.y.rank()))
    ret = pd.DataFrame({"k": "a", "t": range(300), "ret": r.normal(0, 0.01, 300)})
    out = research.performance(spark.createDataFrame(ret), P).first()
    cum = (1 + ret.ret).cumprod()
    run = (ret.ret < 0).astype(int)
    longest = run.groupby((run == 0).cumsum()).sum().max()
    assert out.total_return == pytest.approx(cum.iloc[-1] - 1) and out.max_drawdown == pytest.approx((cum / cum.cummax() - 1).min()) and out.max_consecutive_losses == longest
    dd = research.rolling_metrics(spark.createDataFrame(ret), P, n=20).orderBy("t").collect()
    tail = pd.Series([1.0, *(1 + ret.ret[-20:]).cumprod()])
    assert dd[-1].rolling_drawdown == pytest.approx((tail / tail.cummax() - 1).min())


def test_wavelet_filter_and_bins(spark):
    h = alternative.daubechies(4)
    assert len(h) == 8 and h.sum() == pytest.approx(2**0.5) and (h**2).sum() == pytest.approx(1) and (h[:-2] * h[2:]).sum() == pytest.approx(0, abs=1e-9)
    x = pd.Series(np.random.default_rng(2).normal(size=200))
    got = [r.x_bin for r in alternative.binned(spark.createDataFrame(pd.DataFrame({"i": range(200), "x": x})), "x", 5).orderBy("i").collect()]
    assert got == list(pd.qcut(x, 5, labels=False))


def test_audit_labels(spark):
    df = spark.createDataFrame([(None, 5.0, 1.0, 1.0), (0.0, 5.0, 1.0, 0.0), (9.0, 5.0, 6.0, 1.0)], "c double, h double, l double, v double").withColumn("o", F.lit(1.0))
    got = [r.Issues for r in quality.audited(df, ["c"], ["v"], "o", "h", "l", "c", F.lit(False)).collect()]
    assert got == ["c: null", "c: zero; v: zero; range: close under low", "range: high under low; range: close over high"]
    with pytest.raises(ValueError, match="not before"):
        quality.assert_before(spark.sql("SELECT DATE'2024-01-02' AS d"), "d", "2024-01-02")


@pytest.mark.parametrize("kind", ["timeseries_data", "processed_data", "temporary_data"])
def test_store_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(dt.date(2024, 1, 1 + i % 3), i % 2, float(i)) for i in range(60)], "date date, market_code int, close double")
    store = tables.Store(spark, str(tmp_path))
    store.save(df, kind, "x")
    back = store.load(kind, "x")
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect())) and store.about(kind, "x")["rows"] == 60
    store.remove(kind, "x")
    with pytest.raises(FileNotFoundError):
        store.load(kind, "x")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("ab"[i % 2], i, float(i * 7 % 11)) for i in range(80)], "k string, t long, x double")
    for a in range(0, 80, 40):  # each file a micro-batch
        df.where(f"t >= {a} AND t < {a + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.running(stream, "k", "t", "x", "x").writeStream.format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = spark.table("running").toPandas(), incremental.running(df, "k", "t", "x", "x").toPandas()
    order = ["k", "t"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True))


def test_knn_over_all_blocks_of_donors(spark):
    rng, rows = np.random.default_rng(8), []
    for key, n in (("a", 90), ("b", 41), (None, 30), ("few", 3)):
        for _ in range(n):
            x = rng.integers(0, 12, 3).astype(float)
            rows.append((len(rows), key, *[None if rng.random() < 0.25 else float(v) for v in x]))
    rows += [(1000 + i, "a", 1.0, 2.0, None) for i in range(9)] + [(1100 + i, "a", 1.0, 2.0, 3.0) for i in range(4)] + [(1200, "a", None, None, None), (1300, "gone", 1.0, None, None)]

    def nearest(row, j, k=5):
        found = []
        for other in rows:
            if other[1] == row[1] and other[j] is not None:
                both = [c for c in (2, 3, 4) if row[c] is not None and other[c] is not None]
                if both:
                    found.append((sum((row[c] - other[c]) ** 2 for c in both) * 3 / len(both), other[j]))
        known = [o[j] for o in rows if o[1] == row[1] and o[j] is not None]
        use = [v for _, v in sorted(found)[:k]] or known
        return sum(use) / len(use) if use else None

    want = {r[0]: (r[1], *[r[j] if r[j] is not None else nearest(r, j) for j in (2, 3, 4)]) for r in rows}
    df = spark.createDataFrame(rows, "i long, k string, x double, y double, z double").repartition(3)
    for donors in (7, 2_000):
        got = clean.knn_imputed(df, ["k"], ["x", "y", "z"], 5, donors).collect()
        assert len(got) == len(rows)
        for r in got:
            key, *values = want[r.i]
            assert r.k == key and all(a is None and b is None or abs(a - b) < 1e-9 for a, b in zip((r.x, r.y, r.z), values, strict=True)), (donors, r, want[r.i])
