"""Market reviews, drift history, upkeep of a store and the flows of the command line, against plain Python or pandas."""

import datetime as dt
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel
from tidemark.operators import drift, market, relational
from tidemark.plans import flows
from tidemark.sources.tables import Store, Strategy, read

DAY = dt.date(2023, 1, 2)


def test_suspension_lengths(spark):
    cal = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(40) if (DAY + dt.timedelta(i)).weekday() < 5], "day date")
    at = lambda i: DAY + dt.timedelta(i)
    rows = [(1, at(0), at(4)), (2, at(5), at(6)), (3, at(4), at(7)), (4, at(3), None), (5, None, at(3)), (6, at(9), at(8)), (7, at(2), at(2)), (7, at(2), at(2)), (8, at(-9), at(99))]
    got = market.suspension_lengths(spark.createDataFrame(rows, "k int, SuspendDate date, ResumptionDate date"), cal)
    assert sorted((r.k, r.trading_days, r.natural_days) for r in got.collect()) == [(1, 5, 4), (2, 0, 1), (3, 2, 3), (7, 1, 0), (7, 1, 0), (8, cal.count(), 108)]
    months = {r.month: r for r in market.suspension_length_months(got).collect()}
    assert months[None].n == 6 and months[1].n == 5 and months[12].trading_days_max == cal.count()
    assert market.suspension_length_months(got.limit(0)).where("month IS NOT NULL").count() == 0


def test_reviews_of_no_rows_have_the_row_over_all(spark):
    none = spark.createDataFrame([], "SuspendDate date, trading_days int, natural_days int")
    assert [tuple(r) for r in market.suspension_length_months(none).collect()] == [(None, 0, None, None, None, None, None, None)]
    quotes = spark.createDataFrame([], "k int, d date, o double, c double, v double")
    assert [(r.month, r.n) for r in market.volume_price_months(quotes, Panel(("k",), ("d",)), "d", "o", "c", "v", F.lit(False)).collect()] == [(None, 0)]


def test_price_gaps_leave_out_what_is_no_quote(spark):
    rows = [(10.0, 12.0, 9.0, 11.0, 100.0, 1050.0, 8.0, False), (10.0, 12.0, 9.0, 11.0, 0.0, 5.0, 0.0, None), (10.0, 12.0, 9.0, 11.0, 1.0, 1.0, 8.0, True), (0.0, 12.0, 9.0, 11.0, 1.0, 1.0, 8.0, False), (None, 12.0, 9.0, 11.0, 1.0, 1.0, 8.0, False)]
    df = spark.createDataFrame(rows, "o double, h double, l double, c double, v double, a double, b double, s boolean")
    got = market.price_gaps(df, "o", "h", "l", "c", "v", "a", "b", F.col("s")).collect()
    assert len(got) == 2
    one, two = sorted(got, key=lambda r: r.v, reverse=True)
    assert (one.high_gap, one.low_gap, one.open_noise) == (1.0, 1.0, 25.0)
    assert one.value_factor == pytest.approx((1050 - 1100) / 1100 * 100) and one.average_factor == pytest.approx((10.5 / 11 - 1) * 100)
    assert two.value_factor is None and two.average_factor is None and two.open_noise is None


def test_volume_changes_stay_within_a_series(spark, walk):
    pdf, df = walk
    got = {r.month: r for r in market.volume_price_months(df, Panel(("SecuCode",), ("TradingDay",)), "TradingDay", "OpenPrice", "ClosePrice", "TurnoverVolume", F.lit(False)).collect()}
    x = pdf.sort_values(["SecuCode", "TradingDay"])
    x = x.assign(m=pd.to_datetime(x.TradingDay).dt.month, g=x.groupby("SecuCode").TurnoverVolume.pct_change() * 100, p=(x.ClosePrice / x.OpenPrice - 1) * 100)
    for m, part in [(None, x), *x.groupby("m")]:
        r = got[m]
        assert r.n == len(part)
        np.testing.assert_allclose([r.volume_change_mean, r.volume_change_std, r.move_median, r.volume_mean], [part.g.mean(), part.g.std(), part.p.median(), part.TurnoverVolume.mean()], rtol=1e-9)
    assert set(got) == {None, *x.m}


def test_names_of_codes(spark):
    codes = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int")
    names = spark.createDataFrame([(7, 1, "b"), (7, 1, "a"), (8, 2, "other kind")], "LB int, DM int, MC string")
    assert sorted(str(r.name) for r in relational.named(codes, "k", names, 7, "name").collect()) == ["None", "a", "unknown(2)", "unknown(2)"]


def test_history_is_the_test_of_each_period_with_the_one_before(spark):
    r, rows = np.random.default_rng(1), []
    for y in (1, 2, 4, 5):
        rows += [(y, round(float(r.normal(y == 4, 1)), 1), None if y == 2 else float(r.integers(0, 5)), y) for _ in range(300)]
    rows += [(None, 1.0, 1.0, 0), (1, float("nan"), None, 0)]
    df = spark.createDataFrame(rows, "p int, x double, z double, drifted int")
    got = drift.history(df, "p", ["x", "z"])
    for old, new in ((1, 2), (2, 4), (4, 5)):
        want = drift.ks(df.where(F.col("p") == old), df.where(F.col("p") == new), ["x", "z"]).where("n > 0 AND m > 0").collect()
        mine = {r.feature: r for r in got.where(F.col("period") == new).collect()}
        assert set(mine) == {w.feature for w in want} == ({"x"} if 2 in (old, new) else {"x", "z"})
        for w in want:
            m = mine[w.feature]
            assert (m.n, m.m, m.drifted) == (w.n, w.m, w.drifted) and m.statistic == pytest.approx(w.statistic) and m.p_value == pytest.approx(w.p_value)
    s = drift.summary(got).first()
    assert (s.detections, s.with_drift, s.most_drifted) == (3, 2, "x") and s.max_score > 0.99
    none = drift.summary(got, 99).first()
    assert (none.detections, none.with_drift, none.most_drifted, none.mean_score) == (0, 0, "", None)
    assert drift.history(df.limit(0), "p", ["x"]).count() == 0


def test_store_keeps_strategies_and_cleans_and_copies(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.info().where("kind IS NOT NULL").count() == 0
    store.strategies["mine"] = Strategy(by=("k",), sort=("v",), about="own")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for kind, name in (("raw_data", "one"), ("temporary_data", "old"), ("temporary_data", "new"), ("mine", "m")):
        store.save(df, kind, name)
    path = store.keep_strategies()
    other = Store(spark, store.root, {})
    assert "mine" in other.take_strategies(path) and other.strategies == store.strategies
    got = {(r.kind, r.name): r for r in store.files().collect()}
    assert set(got) == {("raw_data", "one"), ("temporary_data", "old"), ("temporary_data", "new"), ("mine", "m")} and all(r.bytes > 0 and r.files > 0 for r in got.values())
    assert {r.kind: r.tables for r in store.info().collect()} == {"raw_data": 1, "temporary_data": 2, "mine": 1, None: 4}
    past = time.time() - 9 * 86_400
    os.utime(store.path("temporary_data", "old"), (past, past))
    assert store.remove_older() == ["old"] and store.remove_older() == []
    copy = Store(spark, store.back_up(("raw_data", "mine"), "b"), store.strategies)
    assert sorted(map(tuple, copy.load("raw_data", "one").collect())) == [(1, "a"), (2, "b")] and copy.load("mine", "m").count() == 2
    assert copy.about("mine", "m")["rows"] == 2 and set(store.files().select("kind").toPandas().kind) == {"raw_data", "temporary_data", "mine"}


def test_flows(spark, walk, tmp_path):
    _, df = walk
    ref, cur, out = str(tmp_path / "ref"), str(tmp_path / "cur"), str(tmp_path / "out")
    df.write.parquet(ref)
    df.withColumn("TurnoverVolume", F.col("TurnoverVolume") * 5).write.parquet(cur)
    assert flows.main(["report", ref, f"{out}/r", "--target", "ClosePrice"]) == 0
    assert read(spark, f"{out}/r/summary").first()["rows"] == df.count()
    assert {r.column_name for r in read(spark, f"{out}/r/features").collect()} == {"OpenPrice", "HighPrice", "LowPrice", "TurnoverVolume"}
    assert read(spark, f"{out}/r/correlations").count() > 0
    assert flows.main(["drift", ref, cur, f"{out}/d"]) == 0
    assert [r.feature for r in read(spark, f"{out}/d/most").collect()] == ["TurnoverVolume"]
    assert read(spark, f"{out}/d/components").count() == 1
    assert flows.main(["sql", "SELECT SecuCode, count(*) AS n FROM {q} GROUP BY 1", f"{out}/s", "--table", f"q={ref}", "--format", "json"]) == 0
    assert {r.SecuCode: r.n for r in read(spark, f"{out}/s", "json").collect()} == {"a": 300, "b": 120, "c": 5}
    with pytest.raises(ValueError):
        flows.drifted(df.select("SecuCode"), df)
