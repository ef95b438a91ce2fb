"""Models, event windows and incremental features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model
from ..streaming import incremental
from .base import P, bars, query, read, rounded

FEATURES = ["r1", "r5", "vr", "hl"]


def frame(spark, sf):
    b = bars(spark, sf).withColumns({"r1": P.pct("c"), "r5": P.pct("c", 5), "vr": F.try_divide("v", P.mean("v", 20)), "hl": F.try_divide("h", "l") - 1})
    return model.with_target(b, P, "c", 1).dropna()


@query()
def linear_model(spark, sf):
    d = frame(spark, sf)
    m = model.fitted(d, FEATURES, "ridge")
    return rounded(m.transform(d).select("secu", "d", F.col("prediction")), 4)


@query()
def forest_model(spark, sf):
    d = frame(spark, sf)
    worth = model.importance(model.fitted(d, FEATURES, "forest", trees=10), FEATURES)
    return rounded(spark.createDataFrame(sorted(worth.items()), "feature string, importance double"), 4)


@query()
def time_series_validation(spark, sf):
    rows = [(i + 1, x["rmse"], x["r2"]) for i, x in enumerate(model.cross_validated(frame(spark, sf), FEATURES, "d", "ridge", k=3))]
    return rounded(spark.createDataFrame(rows, "fold int, rmse double, r2 double"), 4)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    e = read(spark, sf, "events").select("ts", "event_type", "value")
    return rounded(incremental.windowed(e, "ts", "event_type", "value").drop("end").withColumn("start", F.col("start").cast("timestamp_ntz")), total=4)


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY user_id, k")
def session_events(spark, sf):
    e = read(spark, sf, "events").select("ts", "user_id", "value")
    return rounded(incremental.sessions(e, "ts", "user_id", "value", "3 hours").drop("end").withColumn("start", F.col("start").cast("timestamp_ntz")), total=4)


@query("WITH e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events), w AS (SELECT user_id, ts, min(value) OVER r AS low, max(value) OVER r AS high, sum(value) OVER r AS total, avg(value) OVER k AS mean, stddev_pop(value) OVER k AS std, min(value) OVER k AS window_low, max(value) OVER k AS window_high, count(*) OVER k AS window_n FROM e WINDOW r AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT user_id, ts, round(low, 4) + 0.0 AS low, round(high, 4) + 0.0 AS high, round(total, 4) + 0.0 AS total, round(mean, 4) + 0.0 AS mean, round(std, 4) + 0.0 AS std, round(window_low, 4) + 0.0 AS window_low, round(window_high, 4) + 0.0 AS window_high, round(CAST(window_n AS DOUBLE), 4) + 0.0 AS window_n FROM w")
def incremental_stats(spark, sf):
    e = read(spark, sf, "events").select("user_id", "ts", "value")
    return rounded(incremental.running(e, "user_id", "ts", "value").select("user_id", "ts", "low", "high", "total", "mean", "std", "window_low", "window_high", "window_n"), 4)


@query("WITH RECURSIVE n AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events), e AS (SELECT user_id, ts, rn, value AS ma, value AS ema, value * value AS var FROM n WHERE rn = 1 UNION ALL SELECT n.user_id, n.ts, n.rn, e.ma + (n.value - e.ma) / least(n.rn, 20), n.value * (2 / 13.0) + e.ema * (1 - 2 / 13.0), n.value * n.value * (2 / 13.0) + e.var * (1 - 2 / 13.0) FROM e JOIN n ON n.user_id = e.user_id AND n.rn = e.rn + 1) SELECT user_id, ts, round(ma, 4) + 0.0 AS ma, round(ema, 4) + 0.0 AS ema, round(sqrt(var), 4) + 0.0 AS vol FROM e")
def incremental_means(spark, sf):
    e = read(spark, sf, "events").select("user_id", "ts", "value")
    return rounded(incremental.running(e, "user_id", "ts", "value").select("user_id", "ts", "ma", "ema", "vol"), 4)
