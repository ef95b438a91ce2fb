"""Cleaning, imputation, drift and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, drift, model, quality
from .base import BARS, MONTH_BARS, P, W, bars, month_bars, query, read, rounded, steps

HOLES = BARS + ", x AS (SELECT secu, d, CASE WHEN day(d) % 7 = 3 THEN NULL ELSE c END AS c, CASE WHEN day(d) % 5 = 1 THEN NULL ELSE v END AS v, CASE WHEN day(d) % 11 = 3 THEN NULL ELSE amt END AS amt FROM b)"


def holes(spark, sf):
    day = F.dayofmonth("d")
    return bars(spark, sf).select("secu", "d", F.when(day % 7 != 3, F.col("c")).alias("c"), F.when(day % 5 != 1, F.col("v")).alias("v"), F.when(day % 11 != 3, F.col("amt")).alias("amt"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.75]) AS q FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, q[1] - 1.5 * (q[2] - q[1])), q[2] + 1.5 * (q[2] - q[1])), 4) + 0.0 AS o_totalprice FROM orders, q")
def iqr_clip(spark, sf):
    return rounded(clean.quartile_clipped(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), 4)


@query("WITH e AS (SELECT event_id, value AS a, value AS b, value AS c FROM events), q AS (SELECT quantile_cont(a, [0.25, 0.75]) AS q, avg(a) AS m, stddev_samp(a) AS s, median(a) AS md FROM e), k AS (SELECT median(abs(a - md)) AS mad FROM e, q) SELECT event_id, CASE WHEN a < q[1] - 0.4 * (q[2] - q[1]) OR a > q[2] + 0.4 * (q[2] - q[1]) THEN NULL ELSE round(a, 6) + 0.0 END AS a, CASE WHEN abs((b - m) / s) > 1.2 THEN NULL ELSE round(b, 6) + 0.0 END AS b, CASE WHEN abs(0.6745 * (c - md) / mad) > 0.9 THEN NULL ELSE round(c, 6) + 0.0 END AS c FROM e, q, k")
def outliers_removed(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.col("value").alias("a"), F.col("value").alias("b"), F.col("value").alias("c"))
    return rounded(clean.outliers_removed(clean.outliers_removed(clean.outliers_removed(e, ["a"], "iqr", 0.4), ["b"], "zscore", 1.2), ["c"], "mad", 0.9))


@query("WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi, median(value) AS md FROM events), k AS (SELECT median(abs(value - md)) AS mad FROM events, q) SELECT event_id, round((value - m) / s, 6) + 0.0 AS z, round((value - lo) / (hi - lo), 6) + 0.0 AS u, round((value - md) / mad, 6) + 0.0 AS r FROM events, q, k")
def standardized(spark, sf):
    e = read(spark, sf, "events").select("event_id", "value")
    for how, name in (("zscore", "z"), ("minmax", "u"), ("robust", "r")):
        e = clean.standardized(e, ["value"], how).withColumnRenamed("value_normalized", name)
    return rounded(e.drop("value"))


RUN = "(PARTITION BY secu ORDER BY d ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {HOLES}, f AS (SELECT secu, d, last_value(c IGNORE NULLS) OVER {RUN} AS c, last_value(v IGNORE NULLS) OVER (PARTITION BY secu ORDER BY d ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v, coalesce(amt, avg(amt) OVER (PARTITION BY secu)) AS amt FROM x) SELECT secu, d, round(c, 6) + 0.0 AS c, round(v, 6) + 0.0 AS v, round(amt, 2) + 0.0 AS amt FROM f")
def gaps_filled(spark, sf):
    df = clean.filled(clean.filled(clean.filled(holes(spark, sf), P, ["c"]), P, ["v"], limit=1), P, ["amt"], "mean")
    return rounded(df, amt=2)


@query(f"WITH {HOLES}, m AS (SELECT avg(c) AS c, median(v) AS v FROM x) SELECT secu, d, round(coalesce(x.c, m.c), 6) + 0.0 AS c, round(coalesce(x.v, m.v), 6) + 0.0 AS v FROM x, m")
def impute_mean_median(spark, sf):
    return rounded(clean.imputed(clean.imputed(holes(spark, sf).drop("amt"), ["c"], "mean"), ["v"], "median"))


@query(f"WITH {HOLES} SELECT CAST(CAST(c IS NULL AS INT) AS VARCHAR) || CAST(CAST(v IS NULL AS INT) AS VARCHAR) || CAST(CAST(amt IS NULL AS INT) AS VARCHAR) AS pattern, count(*) AS n FROM x GROUP BY 1")
def missing_patterns(spark, sf):
    return clean.missing_patterns(holes(spark, sf), ["c", "v", "amt"], None)


@query(f"WITH {HOLES}, m AS (SELECT CAST(c IS NULL AS INT) AS a, CAST(v IS NULL AS INT) AS b, CAST(amt IS NULL AS INT) AS e FROM x) SELECT 'c' AS a, 'v' AS b, round(corr(a, b), 6) + 0.0 AS corr FROM m UNION ALL SELECT 'c', 'amt', round(corr(a, e), 6) + 0.0 FROM m UNION ALL SELECT 'v', 'amt', round(corr(b, e), 6) + 0.0 FROM m")
def missing_correlation(spark, sf):
    return rounded(clean.missing_correlation(holes(spark, sf), ["c", "v", "amt"]))


@query(f"WITH {HOLES} SELECT unnest(['secu', 'd', 'c', 'v', 'amt']) AS column_name, unnest([count_if(secu IS NULL), count_if(d IS NULL), count_if(c IS NULL), count_if(v IS NULL), count_if(amt IS NULL)]) AS missing, round(unnest([count_if(secu IS NULL), count_if(d IS NULL), count_if(c IS NULL), count_if(v IS NULL), count_if(amt IS NULL)]) / count(*), 6) + 0.0 AS share FROM x")
def missing_counts(spark, sf):
    return rounded(clean.missing_counts(holes(spark, sf)))


@query()
def missing_kind(spark, sf):
    return rounded(clean.missing_kind(holes(spark, sf), "c", "d", ["v", "amt"]))


@query()
def knn_imputed(spark, sf):
    return rounded(clean.knn_imputed(holes(spark, sf), ["secu"], ["c", "v", "amt"]), 4)


@query()
def time_imputed(spark, sf):
    return rounded(clean.interpolation_imputed(holes(spark, sf).drop("amt"), P, ["c", "v"], "time"))


@query()
def forest_imputed(spark, sf):
    return rounded(clean.forest_imputed(holes(spark, sf), "c", ["v", "amt"]), 4)


def weeks(spark, sf):
    e = read(spark, sf, "events").withColumn("day", F.dayofmonth("ts"))
    return e.where("day <= 15").select("event_id", "value", "event_type"), e.where("day > 15").select("event_id", (F.col("value") * 1.1).alias("value"), "event_type")


HALVES = "WITH r AS (SELECT value AS x, event_type AS t FROM events WHERE day(ts) <= 15), c AS (SELECT value * 1.1 AS x, event_type AS t FROM events WHERE day(ts) > 15)"
CDF = HALVES + ", u AS (SELECT x, 1 AS a, 0 AS b FROM r UNION ALL SELECT x, 0, 1 FROM c), g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM u GROUP BY x), k AS (SELECT x, sum(a) OVER w / (SELECT count(*) FROM r) AS f, sum(b) OVER w / (SELECT count(*) FROM c) AS g, lead(x) OVER (ORDER BY x) - x AS dx FROM g WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))"


@query(CDF + " SELECT 'value' AS feature, round(max(abs(f - g)), 6) + 0.0 AS statistic, (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM c) AS m FROM k")
def ks_drift(spark, sf):
    return rounded(drift.ks(*weeks(spark, sf), ["value"]).select("feature", "statistic", "n", "m"))


@query(CDF + ", d AS (SELECT sum(abs(f - g) * dx) AS d FROM k), s AS (SELECT d, d / (SELECT stddev_samp(x) FROM r) AS q FROM d) SELECT 'value' AS feature, round(d, 6) + 0.0 AS distance, round(q, 6) + 0.0 AS relative, round(least(1.0, q / 0.1), 6) + 0.0 AS score, q > 0.1 AS drifted FROM s")
def wasserstein_drift(spark, sf):
    return rounded(drift.wasserstein(*weeks(spark, sf), ["value"]))


@query(HALVES + ", s AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT x FROM r UNION ALL SELECT x FROM c)), n AS (SELECT least(8, CAST(floor((x - lo) * 9 / (hi - lo)) AS INT)) AS b, sum(a) AS a, sum(z) AS z FROM (SELECT x, 1 AS a, 0 AS z FROM r UNION ALL SELECT x, 0, 1 FROM c), s GROUP BY 1), e AS (SELECT z, (a + 1e-10) * sum(z) OVER () / sum(a) OVER () AS e FROM n) SELECT 'value' AS feature, round(sum(power(z - e, 2) / e), 4) + 0.0 AS statistic FROM e")
def chi2_drift(spark, sf):
    return rounded(drift.chi2(*weeks(spark, sf), ["value"]).select("feature", "statistic"), 4)


@query(HALVES + ", p AS (SELECT t, count(*) / (SELECT count(*) FROM r) AS p FROM r GROUP BY t), q AS (SELECT t, count(*) / (SELECT count(*) FROM c) AS q FROM c GROUP BY t) SELECT round(avg(abs(coalesce(p, 0) - coalesce(q, 0))), 6) + 0.0 AS change FROM p FULL JOIN q USING (t)")
def label_drift(spark, sf):
    return rounded(drift.label_drift(*weeks(spark, sf), "event_type").select("change"))


@query("WITH r AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'only' ELSE event_type END AS t FROM events WHERE day(ts) <= 15), c AS (SELECT event_type AS t FROM events WHERE day(ts) > 15), p AS (SELECT t, count(*) / (SELECT count(*) FROM r) AS p FROM r GROUP BY t), q AS (SELECT t, count(*) / (SELECT count(*) FROM c) AS q FROM c GROUP BY t) SELECT round(avg(abs(p - q)), 6) + 0.0 AS score, avg(abs(p - q)) > 0.2 AS drifted FROM p JOIN q USING (t)")
def concept_drift(spark, sf):
    ref, cur = weeks(spark, sf)
    return rounded(drift.concept_drift(ref.withColumn("event_type", F.when(F.col("event_id") % 7 == 0, "only").otherwise(F.col("event_type"))), cur, "event_type"))


@query()
def score_drop(spark, sf):
    """A model's fall from the first years to the later ones. Both are cut from rows that are computed once."""
    from .models import FEATURES, frame

    with model.kept(frame(spark, sf), ["d", *FEATURES, "target"]) as d:
        return rounded(drift.score_drop(d.where("year(d) < 1998"), d.where("year(d) >= 1998"), FEATURES, "target"), 4)


@query()
def covariate_drift(spark, sf):
    b = bars(spark, sf)
    return rounded(drift.covariate(b.where("year(d) < 1998"), b.where("year(d) >= 1998"), ["o", "h", "l", "c", "v"]))


@query()
def density_drift(spark, sf):
    return rounded(drift.density_ratio(*weeks(spark, sf), ["value"]))


AUDIT = BARS + ", a AS (SELECT secu, d, CASE WHEN day(d) = 3 THEN NULL WHEN day(d) = 4 THEN -999.0 WHEN day(d) = 5 THEN 0.0 WHEN day(d) = 6 THEN -c WHEN day(d) = 7 THEN c * 100 ELSE c END AS c, h, l, CASE WHEN day(d) IN (8, 9) THEN 0.0 ELSE v END AS v, day(d) IN (5, 8) AS susp FROM b)"


def broken(spark, sf):
    day = F.dayofmonth("d")
    c = F.when(day == 4, F.lit(-999.0)).when(day == 5, 0.0).when(day == 6, -F.col("c")).when(day == 7, F.col("c") * 100).when(day != 3, F.col("c"))
    return bars(spark, sf).select("secu", "d", c.alias("c"), "o", "h", "l", F.when(day.isin(8, 9), 0.0).otherwise(F.col("v")).alias("v"), day.isin(5, 8).alias("susp"))


ISSUES = """concat_ws('; ', CASE WHEN c IS NULL THEN 'c: null' WHEN c IN (-1, -999, -9999, 999, 9999, 99999) THEN 'c: placeholder' WHEN c = 0 AND susp THEN 'c: zero while suspended' WHEN c = 0 THEN 'c: zero' WHEN c < 0 THEN 'c: negative' WHEN c > 10000 THEN 'c: too high' WHEN c < 0.01 AND c > 0 THEN 'c: too low' END,
CASE WHEN v IS NULL THEN 'v: null' WHEN v IN (-1, -999, -9999, 999, 9999, 99999) THEN 'v: placeholder' WHEN v = 0 AND NOT susp THEN 'v: zero' WHEN v < 0 THEN 'v: negative' END,
CASE WHEN h < l THEN 'range: high under low' END, CASE WHEN c > h THEN 'range: close over high' END, CASE WHEN c < l THEN 'range: close under low' END)"""


def _audited(spark, sf):
    return quality.audited(broken(spark, sf), ["c"], ["v"], "o", "h", "l", "c", F.col("susp"))


@query(f"WITH {AUDIT}, i AS (SELECT secu, d, {ISSUES} AS \"Issues\" FROM a) SELECT secu, d, \"Issues\", CASE WHEN \"Issues\" = '' THEN 0 ELSE CAST(len(string_split(\"Issues\", '; ')) AS INTEGER) END AS \"IssueCount\" FROM i")
def qa_rules(spark, sf):
    return _audited(spark, sf).select("secu", "d", "Issues", "IssueCount")


@query(f"WITH {AUDIT}, i AS (SELECT secu, {ISSUES} AS s FROM a), e AS (SELECT secu, unnest(string_split(s, '; ')) AS x FROM i WHERE s <> '') SELECT secu, string_split(x, ':')[1] AS issue, count(*) AS n FROM e GROUP BY ALL")
def qa_histogram(spark, sf):
    return quality.issue_histogram(_audited(spark, sf), ["secu"])


@query(f"WITH {AUDIT}, i AS (SELECT secu, month(d) AS m, {ISSUES} AS s FROM a), n AS (SELECT *, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, '; ')) END AS k FROM i) SELECT secu, CAST(m AS INTEGER) AS m, count(*) AS rows, count_if(k > 0) AS with_issues, count_if(k > 1) AS with_several, CAST(sum(k) AS BIGINT) AS issues FROM n GROUP BY secu, m")
def qa_summary(spark, sf):
    return quality.audit_summary(_audited(spark, sf).withColumn("m", F.month("d")), ["secu", "m"])


@query(f"WITH {MONTH_BARS}, n AS (SELECT *, row_number() OVER {W} AS days, lag(c) OVER {W} AS pc FROM b), r AS (SELECT *, abs((c - pc) / nullif(pc, 0)) AS r, CASE WHEN secu % 7 IN (6, 0) THEN 0.2 ELSE 0.1 END AS lim FROM n) SELECT secu, d, CASE WHEN days > 5 AND days <= 30 AND r > lim + 0.001 THEN 'beyond limit' WHEN days > 5 AND days <= 30 AND r IS NULL THEN 'no previous close' END AS \"LimitIssue\" FROM r")
def limit_rules(spark, sf):
    from pyspark.sql.window import Window

    df = month_bars(spark, sf).withColumns({"days": F.row_number().over(Window.partitionBy("secu").orderBy("d")), "pc": P.lag("c"), "sector": F.when(F.col("secu") % 7 == 0, 7).otherwise(F.col("secu") % 7)})
    return quality.limit_rules(df, P, "c", "pc", "days", "sector").select("secu", "d", "LimitIssue")


@query(f"WITH {HOLES} SELECT secu, d, concat_ws(',', CASE WHEN c IS NULL THEN 'c' END, CASE WHEN v IS NULL THEN 'v' END, CASE WHEN amt IS NULL THEN 'amt' END) AS \"NullColumns\" FROM x WHERE c IS NULL OR v IS NULL OR amt IS NULL")
def null_columns(spark, sf):
    return quality.null_columns(holes(spark, sf), ["c", "v", "amt"]).select("secu", "d", "NullColumns")


BANDS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1)


@query(f"WITH {BARS}, r AS (SELECT secu, o / nullif(lag(c) OVER {W}, 0) AS x FROM b) SELECT secu, count(x) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS min, round(max(x), 6) + 0.0 AS max, " + ", ".join(f"round(avg(CASE WHEN abs(x - 1) <= {b} THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END), 6) + 0.0 AS within_{round(b * 1000)}" for b in BANDS) + ", " + ", ".join(f"round(quantile_cont(x, {p / 100}), 6) + 0.0 AS p{p}" for p in (1, 5, 25, 50, 75, 95, 99)) + " FROM r GROUP BY secu")
def open_gap_stats(spark, sf):
    df = bars(spark, sf).withColumn("x", F.try_divide("o", P.lag("c")))
    return rounded(quality.open_gap_stats(df, ["secu"], "x"))


@query(f"WITH {BARS}, r AS (SELECT secu, d, o / nullif(lag(c) OVER {W}, 0) AS x FROM b), s AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM r) SELECT secu, d, round(x, 6) + 0.0 AS x FROM r, s WHERE abs(x - m) > 2 * s")
def open_gap_extremes(spark, sf):
    df = bars(spark, sf).select("secu", "d", F.try_divide("o", P.lag("c")).alias("x"))
    return rounded(quality.extremes(df, "x", 2.0))


@query(f"WITH {BARS}, r AS (SELECT secu, (c / lag(c) OVER {W} - 1) * 100 AS x FROM b) SELECT secu, count(x) AS n, count_if(x > 0) AS up, count_if(x < 0) AS down, count_if(x >= 9.8) AS limit_up, count_if(x <= -9.8) AS limit_down, count_if(abs(x) > 8) AS large, count_if(abs(x) > 3 AND abs(x) <= 8) AS medium, count_if(abs(x) <= 3) AS small FROM r GROUP BY secu")
def change_pct_bands(spark, sf):
    return quality.change_bands(bars(spark, sf).withColumn("x", P.pct("c") * 100), ["secu"], "x")


@query(steps({"avg_price": "amt / nullif(v, 0)"}, {"above_high": "(avg_price - h) / h", "below_low": "(l - avg_price) / l"}, out=["avg_price", "above_high", "below_low"]))
def average_price_ratios(spark, sf):
    return rounded(quality.average_price_ratios(bars(spark, sf), "amt", "v", "h", "l").select("secu", "d", "avg_price", "above_high", "below_low"))


@query(f"WITH {BARS}, r AS (SELECT v, lead(c) OVER {W} / c - 1 AS y FROM b), q AS (SELECT quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS q FROM r) SELECT CAST(len(list_filter(q, lambda e: e < v)) + 1 AS INTEGER) AS bucket, count(y) AS n, round(avg(y), 6) + 0.0 AS mean, round(stddev_samp(y), 6) + 0.0 AS std, round(median(y), 6) + 0.0 AS median FROM r, q GROUP BY 1")
def turnover_quintiles(spark, sf):
    df = bars(spark, sf).withColumn("y", F.try_divide(P.lead("c"), "c") - 1)
    return rounded(quality.quintiles(df, "v", "y"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42')) AS k FROM orders) WHERE k <= 20")
def monthly_sample(spark, sf):
    o = read(spark, sf, "orders")
    return quality.sampled(o, F.date_trunc("month", "o_orderdate"), ["o_orderkey"], 20).select("o_orderkey")


@query(f"WITH {BARS} SELECT secu, d, CAST(d - lag(d) OVER {W} AS INTEGER) AS gap_days FROM b")
def trading_gaps(spark, sf):
    return quality.gaps(bars(spark, sf).select("secu", "d"), P, "d")


@query(steps({"pc": f"lag(c) OVER {W}"}, {"filled_open": "CASE WHEN pc IS NOT NULL THEN least(greatest(pc * 1.01, l), h) END"}, out=["filled_open"]))
def fill_open(spark, sf):
    df = quality.fill_open(bars(spark, sf).withColumn("pc", P.lag("c")), "pc", F.lit(1.01), "l", "h")
    return rounded(df.select("secu", "d", F.when(F.col("pc").isNotNull(), F.col("filled_open")).alias("filled_open")))


@query(f"WITH {MONTH_BARS}, x AS (SELECT secu, d, c / lag(c) OVER {W} - 1 AS c, v / lag(v) OVER {W} - 1 AS v FROM b) SELECT secu, d, 'c' AS column_name, round(c, 6) + 0.0 AS change FROM x WHERE abs(c) > 0.5 UNION ALL SELECT secu, d, 'v', round(v, 6) + 0.0 FROM x WHERE abs(v) > 0.5")
def lookahead_flags(spark, sf):
    return rounded(quality.lookahead(month_bars(spark, sf), P, ["c", "v"]))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.75]) AS q FROM orders), c AS (SELECT quantile_cont(c_acctbal, [0.25, 0.75]) AS q FROM customer) SELECT 'c_acctbal' AS column_name, count_if(c_acctbal < q[1] - 1.5 * (q[2] - q[1]) OR c_acctbal > q[2] + 1.5 * (q[2] - q[1])) AS outliers, count_if(c_acctbal < 0) AS negatives, round(avg(CAST(c_acctbal = 0 AS INT)), 6) + 0.0 AS zero_share FROM customer, c")
def consistency(spark, sf):
    return rounded(quality.consistency(read(spark, sf, "customer"), ["c_acctbal"]))


@query("SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS count, round(avg(o_totalprice), 4) + 0.0 AS mean, round(stddev_samp(o_totalprice), 4) + 0.0 AS std, round(min(o_totalprice), 4) + 0.0 AS min, round(quantile_cont(o_totalprice, 0.25), 4) + 0.0 AS q25, round(median(o_totalprice), 4) + 0.0 AS median, round(quantile_cont(o_totalprice, 0.75), 4) + 0.0 AS q75, round(max(o_totalprice), 4) + 0.0 AS max FROM orders")
def described(spark, sf):
    return rounded(quality.described(read(spark, sf, "orders"), ["o_totalprice"]), 4)


@query("WITH p AS (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) SELECT round(count(*) / sum(n), 6) + 0.0 AS distinct_share, round(max(n) / min(n), 6) + 0.0 AS imbalance FROM p")
def category_balance(spark, sf):
    return rounded(quality.categories(read(spark, sf, "orders"), "o_orderpriority"))


@query("WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n - 1) AS BIGINT) AS repeated_rows, CAST(sum(n) AS BIGINT) AS rows FROM g")
def validation(spark, sf):
    return quality.validation(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"]).select("repeated_rows", "rows")
