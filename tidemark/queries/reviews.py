"""Market reviews by month, suspensions' lengths and names, drift from year to year."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, market, relational
from .base import BARS, MONTH_BARS, P, W, bars, month_bars, query, read, rounded
from .frames import CAL, _calendar
from .tables import SUSPEND, suspensions_of

STATE = "CASE WHEN month(d) = 3 THEN true WHEN month(d) = 4 THEN NULL ELSE false END"


def _suspended():
    return F.when(F.month("d") == 3, True).when(F.month("d") != 4, False)


def _stats(names: list[str], median: tuple[str, ...] = (), digits: int = 6) -> str:
    one = [f"round({f}({n}), {digits}) + 0.0 AS {n}_{k}" for n in names for k, f in (("mean", "avg"), ("std", "stddev_samp"))]
    return ", ".join([*one, *[f"round(median({n}), {digits}) + 0.0 AS {n}_median" for n in median]])


GAPS = ["high_gap", "high_gap_pct", "low_gap", "low_gap_pct", "value_factor", "average_factor", "open_noise"]


@query(f"""WITH {MONTH_BARS}, q AS (SELECT *, {STATE} AS s, lag(c) OVER {W} AS pc FROM b), g AS (SELECT CAST(month(d) AS INTEGER) AS month, h - greatest(o, c) AS high_gap, (h - greatest(o, c)) / greatest(o, c) * 100 AS high_gap_pct, least(o, c) - l AS low_gap, (least(o, c) - l) / least(o, c) * 100 AS low_gap_pct,
(amt - v * c) / nullif(v * c, 0) * 100 AS value_factor, (amt / nullif(v, 0) / c - 1) * 100 AS average_factor, (o / nullif(pc, 0) - 1) * 100 AS open_noise FROM q WHERE o > 0 AND h > 0 AND l > 0 AND c > 0 AND coalesce(NOT s, true))
SELECT month, count(*) AS n, {_stats(GAPS, ('open_noise',))} FROM g GROUP BY ROLLUP (month)""")
def price_gap_months(spark, sf):
    df = month_bars(spark, sf).withColumn("pc", P.lag("c"))
    return rounded(market.price_gap_months(df, "d", "o", "h", "l", "c", "v", "amt", "pc", suspended=_suspended()))


@query(f"""WITH {MONTH_BARS}, g AS (SELECT CAST(month(d) AS INTEGER) AS month, v AS volume, (c / o - 1) * 100 AS move, (v / lag(v) OVER {W} - 1) * 100 AS volume_change FROM (SELECT *, {STATE} AS s FROM b) WHERE v > 0 AND o > 0 AND c > 0 AND coalesce(NOT s, true))
SELECT month, count(*) AS n, {_stats(['volume', 'move', 'volume_change'], ('volume', 'move'), 5)} FROM g GROUP BY ROLLUP (month)""")
def volume_price_months(spark, sf):
    return rounded(market.volume_price_months(month_bars(spark, sf), P, "d", "o", "c", "v", _suspended()), 5)


LENGTHS = f"""{SUSPEND}, {CAL}, k AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM cal), len AS (SELECT s.*, CAST(coalesce(y.n, 0) - coalesce(x.n, 0) AS INTEGER) AS trading_days, CAST(s."ResumptionDate" - s."SuspendDate" AS INTEGER) AS natural_days
FROM (SELECT *, CAST("SuspendDate" - 1 AS DATE) AS eve FROM susp WHERE "ResumptionDate" >= "SuspendDate") s ASOF LEFT JOIN k y ON s."ResumptionDate" >= y.day ASOF LEFT JOIN k x ON s.eve >= x.day)"""


def _lengths(spark, sf):
    return market.suspension_lengths(suspensions_of(spark, sf), _calendar(spark, sf))


@query(LENGTHS + """ SELECT "InnerCode", "SuspendDate", "ResumptionDate", trading_days, natural_days FROM len""")
def suspension_lengths(spark, sf):
    return _lengths(spark, sf).select("InnerCode", "SuspendDate", "ResumptionDate", "trading_days", "natural_days")


@query(LENGTHS + " SELECT trading_days, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM len GROUP BY 1")
def suspension_length_shares(spark, sf):
    return rounded(relational.shares(_lengths(spark, sf), "trading_days"))


@query(LENGTHS + f""" SELECT month, count(*) AS n, {_stats(['trading_days', 'natural_days'])}, min(trading_days) AS trading_days_min, max(trading_days) AS trading_days_max FROM (SELECT *, CAST(month("SuspendDate") AS INTEGER) AS month FROM len) GROUP BY ROLLUP (month)""")
def suspension_length_months(spark, sf):
    return rounded(market.suspension_length_months(_lengths(spark, sf)))


@query(SUSPEND + """, t AS (SELECT CASE WHEN "InfoSource" = 30 THEN 99 ELSE 8 + CAST("InfoSource" / 10 AS INTEGER) END AS "SuspendType", * FROM susp), k AS (SELECT n_nationkey AS dm, min(n_name) AS mc FROM nation WHERE n_regionkey = 2 GROUP BY 1), a AS (SELECT "SuspendType", count(*) AS n, count(DISTINCT "InnerCode") AS stocks, round(avg("ResumptionDate" - "SuspendDate"), 6) + 0.0 AS avg_days FROM t GROUP BY 1)
SELECT a.*, coalesce(mc, 'unknown(' || "SuspendType" || ')') AS "TypeName" FROM a LEFT JOIN k ON dm = "SuspendType" """)
def suspension_by_type(spark, sf):
    """Counts and mean days by type, whose names are in a table of constants."""
    kind = F.when(F.col("InfoSource") == 30, 99).otherwise((F.col("InfoSource") / 10).cast("int") + 8)
    names = read(spark, sf, "nation").select(F.col("n_regionkey").alias("LB"), F.col("n_nationkey").alias("DM"), F.col("n_name").alias("MC"))
    return relational.named(rounded(relational.suspension_stats(suspensions_of(spark, sf).withColumn("SuspendType", kind), "SuspendType")), "SuspendType", names, 2, "TypeName")


@query(SUSPEND + """ SELECT count(*) AS total_records, min("SuspendDate") AS earliest_date, max("SuspendDate") AS latest_date, count(DISTINCT "InnerCode") AS unique_securities FROM susp""")
def suspension_facts(spark, sf):
    return relational.table_facts(suspensions_of(spark, sf), "SuspendDate", "InnerCode")


DRIFT = f"""WITH {BARS}, r AS (SELECT CAST(year(d) AS INTEGER) AS y, 'c' AS feature, c AS x FROM b UNION ALL SELECT CAST(year(d) AS INTEGER), 'v', v FROM b), ys AS (SELECT y, lead(y) OVER (ORDER BY y) AS nxt FROM (SELECT DISTINCT y FROM r)),
u AS (SELECT y AS period, feature, x, 0 AS a, 1 AS z FROM r WHERE x IS NOT NULL UNION ALL SELECT nxt, feature, x, 1, 0 FROM r JOIN ys USING (y) WHERE nxt IS NOT NULL AND x IS NOT NULL), g AS (SELECT period, feature, x, sum(a) AS a, sum(z) AS z FROM u GROUP BY ALL),
k AS (SELECT period, feature, sum(a) OVER w AS f, sum(z) OVER w AS g, sum(a) OVER p AS n, sum(z) OVER p AS m FROM g WINDOW w AS (PARTITION BY period, feature ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY period, feature)),
s AS (SELECT period, feature, max(abs(f / n - g / m)) AS statistic, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m FROM k WHERE n > 0 AND m > 0 GROUP BY ALL), e AS (SELECT *, statistic * sqrt(n * m / (n + m)) AS q FROM s),
t AS (SELECT e.*, i FROM e, range(1, 30) AS o(i)), h AS (SELECT period, feature, statistic, n, m, CASE WHEN q < 0.3 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * q * q)))) END AS p_value FROM t GROUP BY period, feature, statistic, n, m, q)"""


def _history(spark, sf):
    return drift.history(bars(spark, sf).withColumn("year", F.year("d")), "year", ["c", "v"])


@query(DRIFT + " SELECT period, feature, round(statistic, 6) + 0.0 AS statistic, n, m, round(p_value, 5) + 0.0 AS p_value, p_value < 0.05 AS drifted FROM h")
def drift_history(spark, sf):
    """Each year's close and volume against those of the year before."""
    return rounded(_history(spark, sf).drop("score"), p_value=5)


@query(DRIFT + """, f AS (SELECT *, 1 - p_value AS score, p_value < 0.05 AS drifted FROM h WHERE period >= 1994), o AS (SELECT period, avg(score) AS score, bool_or(drifted) AS drifted FROM f GROUP BY 1), c AS (SELECT feature, count(*) AS k FROM f WHERE drifted GROUP BY 1 ORDER BY k DESC, feature LIMIT 5)
SELECT count(*) AS detections, count_if(drifted) AS with_drift, round(avg(CAST(drifted AS DOUBLE)), 6) + 0.0 AS drift_rate, round(avg(score), 5) + 0.0 AS mean_score, round(max(score), 5) + 0.0 AS max_score, (SELECT coalesce(string_agg(feature, ',' ORDER BY k DESC, feature), '') FROM c) AS most_drifted FROM o""")
def drift_summary(spark, sf):
    return rounded(drift.summary(_history(spark, sf), 1994), mean_score=5, max_score=5)
