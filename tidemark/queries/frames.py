"""Time-series frames: resampling, alignment, as-of joins, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, timeseries
from .base import B, BARS, MONTH_BARS, P, W, bars, lag, log, month_bars, pct, query, read, roll, rounded, steps

DAYS = "days AS (SELECT DISTINCT d AS day FROM b)"


def _resample_sql(end: str) -> str:
    return f"WITH {BARS} SELECT secu, {end} AS d, round(first(o ORDER BY d), 6) + 0.0 AS o, round(max(h), 6) + 0.0 AS h, round(min(l), 6) + 0.0 AS l, round(last(c ORDER BY d), 6) + 0.0 AS c, round(sum(v), 6) + 0.0 AS v, round(sum(amt), 2) + 0.0 AS amt FROM b GROUP BY secu, {end}"


@query(_resample_sql("last_day(d)"))
def resample_month(spark, sf):
    return rounded(timeseries.resampled(bars(spark, sf), "M", "ohlc", ["secu"], "d", B, "amt"), amt=2)


@query(_resample_sql("CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE)"))
def resample_week(spark, sf):
    return rounded(timeseries.resampled(bars(spark, sf), "W", "ohlc", ["secu"], "d", B, "amt"), amt=2)


@query(f"WITH {BARS} SELECT secu, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS d, round(avg(c), 6) + 0.0 AS c, round(avg(v), 6) + 0.0 AS v FROM b GROUP BY ALL")
def resample_quarter_mean(spark, sf):
    return rounded(timeseries.resampled(bars(spark, sf).select("secu", "d", "c", "v"), "Q", "mean", ["secu"], "d"))


@query(f"""WITH {MONTH_BARS}, span AS (SELECT secu, min(d) AS a, max(d) AS z FROM b GROUP BY secu), g AS (SELECT secu, last_day(CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE)) AS d FROM span)
SELECT g.secu, g.d, round(b.c, 6) + 0.0 AS c, round(coalesce(b.v, 0.0), 6) + 0.0 AS v FROM g LEFT JOIN b ON b.secu = g.secu AND last_day(b.d) = g.d""")
def resample_fill_empty(spark, sf):
    return rounded(timeseries.resampled(month_bars(spark, sf), "M", "ohlc", ["secu"], "d", B, "amt", fill_empty=True).select("secu", "d", "c", "v"))


@query(steps({"a": "avg(c) OVER (PARTITION BY secu ORDER BY d ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)", "n0": "count(c) OVER (PARTITION BY secu ORDER BY d ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)", "s": "stddev_samp(c) OVER (PARTITION BY secu ORDER BY d ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)"}, {"c_mean": "CASE WHEN n0 = 10 THEN a END", "c_std": "CASE WHEN n0 = 10 THEN s END"}, out=["c_mean", "c_std"]))
def rolling_centred(spark, sf):
    return rounded(timeseries.rolling(bars(spark, sf), P, ["c"], 10, centre=True).select("secu", "d", "c_mean", "c_std"))


@query(steps({"x": f"(1 * {lag('c', 2)} + 2 * {lag('c', 1)} + 3 * c) / 6.0"}, out=["x"]))
def rolling_weighted(spark, sf):
    return rounded(timeseries.weighted_mean(bars(spark, sf), P, "c", [1, 2, 3], "x").select("secu", "d", "x"))


GK = "0.5 * power(ln(h / l), 2) - 0.3862943611198906 * power(ln(c / o), 2)"


@query(steps({"r": pct("c"), "lr": log(f"(c / {lag('c')})"), "pk": "power(ln(h / l), 2) / 2.772588722239781", "gk": GK}, {"sv": f"({roll('stddev_samp', 'r', 20)}) * sqrt(252.0)", "pv": f"sqrt(({roll('avg', 'pk', 20)}) * 252)", "gm": roll("avg", "gk", 20)}, {"gv": "CASE WHEN gm >= 0 THEN sqrt(gm * 252) END"}, out=["r", "lr", "sv", "pv", "gv"]))
def series_volatility(spark, sf):
    df = timeseries.simple_returns(timeseries.simple_returns(bars(spark, sf), P, "c", name="r"), P, "c", "log", "lr")
    for how, name in (("std", "sv"), ("parkinson", "pv"), ("garman_klass", "gv")):
        df = timeseries.rolling_volatility(df, P, B, 20, how, name)
    return rounded(df.select("secu", "d", "r", "lr", "sv", "pv", "gv"))


@query(f"WITH {BARS} SELECT secu, d, CAST(year(d) AS INTEGER) AS \"Year\", CAST(month(d) AS INTEGER) AS \"Month\", CAST(day(d) AS INTEGER) AS \"Day\", CAST(isodow(d) - 1 AS INTEGER) AS \"DayOfWeek\", CAST(quarter(d) AS INTEGER) AS \"Quarter\", CAST(dayofyear(d) AS INTEGER) AS \"DayOfYear\", CAST(day(d) = 1 AS INTEGER) AS \"IsMonthStart\", CAST(last_day(d) = d AS INTEGER) AS \"IsMonthEnd\", CAST(date_trunc('quarter', d) = d AS INTEGER) AS \"IsQuarterStart\", CAST(date_trunc('quarter', d + INTERVAL 1 DAY) = d + INTERVAL 1 DAY AS INTEGER) AS \"IsQuarterEnd\" FROM b")
def time_fields(spark, sf):
    return timeseries.time_fields(bars(spark, sf).select("secu", "d"), "d")


@query(f"WITH {BARS} SELECT secu, d, round(c, 6) + 0.0 AS c, round(v, 6) + 0.0 AS v FROM b WHERE v >= 50 AND c >= 1000 AND c <= 1800")
def filter_traded(spark, sf):
    return rounded(timeseries.traded(bars(spark, sf), "v", "c", 50, 1000, 1800).select("secu", "d", "c", "v"))


GRID = "grid AS (SELECT k.secu, t.d, b.c FROM (SELECT DISTINCT secu FROM b) k CROSS JOIN (SELECT DISTINCT d FROM b) t LEFT JOIN b ON b.secu = k.secu AND b.d = t.d)"


@query(f"WITH {MONTH_BARS}, {GRID} SELECT secu, d, round(last_value(c IGNORE NULLS) OVER (PARTITION BY secu ORDER BY d ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS c FROM grid")
def align_ffill(spark, sf):
    return rounded(joins.aligned(month_bars(spark, sf), "secu", "d", ["c"]))


@query(f"""WITH {MONTH_BARS}, {GRID}, i AS (SELECT *, row_number() OVER {W} AS n FROM grid),
j AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY secu ORDER BY d ROWS UNBOUNDED PRECEDING) AS p, first_value(c IGNORE NULLS) OVER (PARTITION BY secu ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q, last_value(CASE WHEN c IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY secu ORDER BY d ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN c IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY secu ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM i)
SELECT secu, d, round(CASE WHEN c IS NOT NULL OR q IS NULL THEN p WHEN p IS NOT NULL THEN p + (q - p) * (CAST(n - a AS DOUBLE) / nullif(z - a, 0)) END, 6) + 0.0 AS c FROM j""")
def align_interpolate(spark, sf):
    return rounded(joins.aligned(month_bars(spark, sf), "secu", "d", ["c"], "interpolate"))


FACTORS = "f AS (SELECT secu, min(d) AS since, 1 + (year(d) - 1995) / 20.0 AS factor FROM b GROUP BY secu, year(d))"


def factors(df):
    return df.groupBy("secu", F.year("d").alias("y")).agg(F.min("d").alias("since")).select("secu", "since", (1 + (F.col("y") - 1995) / F.lit(20.0)).alias("factor"))


@query(f"WITH {BARS}, {FACTORS}, late AS (SELECT * FROM f WHERE since >= DATE '1996-01-01') SELECT b.secu, b.d, round(coalesce(late.factor, 1.0), 6) + 0.0 AS factor, round(b.c * coalesce(late.factor, 1.0), 6) + 0.0 AS c_fwd, round(b.c / coalesce(late.factor, 1.0), 6) + 0.0 AS c_back FROM b ASOF LEFT JOIN late ON b.secu = late.secu AND b.d >= late.since")
def asof_factor(spark, sf):
    """Factors of 1995 are left out, so that days before the first have none."""
    b = bars(spark, sf)
    df = timeseries.with_factor(b.select("secu", "d", "c"), factors(b).where("since >= date'1996-01-01'"), ["secu"], "d", "since", "factor")
    df = timeseries.adjusted(df, ["c"]  , "factor").withColumnRenamed("c_Adj", "c_fwd")
    return rounded(timeseries.adjusted(df, ["c"], "factor", "backward").withColumnRenamed("c_Adj", "c_back").drop("c"))


@query(f"WITH {BARS}, {FACTORS}, x AS (SELECT CASE WHEN secu = 1 THEN NULL WHEN secu = 2 THEN 0.0 WHEN secu = 3 THEN -factor ELSE factor END AS factor FROM f) SELECT count(*) AS total, count_if(factor IS NULL) AS nulls, count_if(factor = 0) AS zeros, count_if(factor < 0) AS negatives, count_if(factor > 0 AND factor < 0.001) AS tiny, count_if(factor > 1000) AS huge, count_if(factor BETWEEN 0.001 AND 1000) AS normal, round(min(factor), 6) + 0.0 AS least, round(max(factor), 6) + 0.0 AS most, round(avg(factor), 6) + 0.0 AS mean, round(median(factor), 6) + 0.0 AS median FROM x")
def factor_checks(spark, sf):
    x = factors(bars(spark, sf)).withColumn("factor", F.expr("case when secu = 1 then null when secu = 2 then 0.0D when secu = 3 then -factor else factor end"))
    return rounded(timeseries.factor_checks(x, "factor"))


@query(f"WITH {BARS}, ev AS (SELECT DISTINCT secu, min(d) OVER (PARTITION BY secu, year(d), month(d)) AS day FROM b) SELECT b.secu, b.d, CAST(ev.day IS NOT NULL AS INTEGER) AS first_of_month FROM b LEFT JOIN ev ON ev.secu = b.secu AND ev.day = b.d")
def point_in_time_flags(spark, sf):
    b = bars(spark, sf).select("secu", "d")
    events = b.groupBy("secu", F.trunc("d", "month").alias("m")).agg(F.min("d").alias("day"))
    return joins.event_flag(b, events, ["secu"], "d", "day", "first_of_month")


@query(f"WITH {MONTH_BARS} SELECT x.secu, x.d, round(x.c, 6) + 0.0 AS c, round(y.c, 6) + 0.0 AS c_ago, round(x.c / nullif(y.c, 0) - 1, 6) + 0.0 AS yoy FROM b x LEFT JOIN b y ON y.secu = x.secu AND y.d + INTERVAL 12 MONTH = x.d")
def year_ago_join(spark, sf):
    df = joins.year_ago(month_bars(spark, sf).select("secu", "d", "c"), ["secu"], "d", ["c"])
    return rounded(df.withColumn("yoy", F.try_divide("c", "c_ago") - 1))


CAL = "cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE day(l_shipdate) > 5)"


def _calendar(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).where("day(day) > 5").distinct()


@query(f"WITH {CAL}, q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT q.d, CAST(EXISTS (SELECT 1 FROM cal WHERE day = q.d) AS INTEGER) AS is_trading_day, (SELECT max(day) FROM cal WHERE day < q.d) AS previous_trading_day, (SELECT min(day) FROM cal WHERE day > q.d) AS next_trading_day, (SELECT max(day) FROM cal WHERE day <= q.d) AS as_trading_day FROM q")
def trading_neighbours(spark, sf):
    q = read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return timeseries.neighbours(q, _calendar(spark, sf), "d")


@query(f"WITH {CAL}, n AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM cal), q AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 30 AS e FROM orders) SELECT q.o_orderkey, CAST(coalesce(y.n, 0) - coalesce(x.n, 0) AS INTEGER) AS trading_days FROM q ASOF LEFT JOIN n y ON q.e >= y.day ASOF LEFT JOIN n x ON q.s > x.day")
def trading_days_between(spark, sf):
    q = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("s")).withColumn("e", F.date_add("s", 30))
    return joins.between_ordinals(q, _calendar(spark, sf), "s", "e").select("o_orderkey", "trading_days")


@query("WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS day FROM o) SELECT day FROM g WHERE isodow(day) < 6 AND day NOT IN (SELECT d FROM o WHERE day(d) = 1 OR day(d) = 15)")
def trading_calendar(spark, sf):
    """Working days of the orders' time, but for the first and fifteenth days on which there are orders."""
    days = read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    first, last = days.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    return timeseries.trading_days(spark, first, last, days.where("day(day) IN (1, 15)").distinct())


@query(f"WITH {CAL}, n AS (SELECT day AS start, lead(day, 19) OVER (ORDER BY day) AS \"end\", row_number() OVER (ORDER BY day) AS n FROM cal) SELECT start, \"end\" FROM n WHERE \"end\" IS NOT NULL AND (n - 1) % 5 = 0")
def rolling_windows(spark, sf):
    return timeseries.rolling_spans(_calendar(spark, sf), 20, 5)


@query("WITH q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT d, CAST(year(d - INTERVAL 3 MONTH) AS INTEGER) AS fiscal_year, CAST(quarter(d - INTERVAL 3 MONTH) AS INTEGER) AS fiscal_quarter, CAST(last_day(d) = d AS INTEGER) AS is_month_end, CAST(last_day(d) = d AND month(d) % 3 = 0 AS INTEGER) AS is_quarter_end, CAST(month(d) = 12 AND day(d) = 31 AS INTEGER) AS is_year_end, CAST(d - INTERVAL 6 MONTH AS DATE) AS half_year_before FROM q")
def fiscal_periods(spark, sf):
    q = read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return timeseries.fiscal(q, "d").withColumn("half_year_before", timeseries.period_bounds(F.col("d"), "6m"))
