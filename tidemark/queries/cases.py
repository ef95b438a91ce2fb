"""Queries over listings, filings, opening prices, validation and whole compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.panel import rolling_apply
from ..operators import fundamental, joins, model, opening, quality, relational, research, technical, volume
from ..operators import warehouse as wh
from ..sources import tables
from .base import B, BARS, FLAG_BARS, MONTH_BARS, P, R, W, bars, flag_bars, month_bars, query, read, rounded
from .models import FEATURES, frame
from .tables import SOURCES, SUSPEND, suspensions_of

NOISE = "(CAST('0x' || substr(md5(secu || '|' || strftime(d, '%Y-%m-%d') || '|42'), 1, 8) AS BIGINT) / 2147483648.0 - 1)"
OPENING = {
    "fill_previous": "pc", "fill_mean": "pc * m", "fill_median": "pc * md", "fill_sector": "pc * own", "fill_random": "pc * (m + s * u)",
    "fill_limited": "CASE WHEN pc IS NOT NULL THEN least(greatest(pc * m, l), h) END", "noise_tight": "pc * (1 + 0.001 * u)", "noise_std": "pc * (1 + s * u)",
    "noise_wide": "pc * (1 + 0.012 * u)", "noise_sector": "pc * (1 + own_s * u)", "noise_mixed": "pc * (m + s * u)",
}


@query(
    f"WITH {FLAG_BARS}, x AS (SELECT secu, d, CASE WHEN day(d) % 7 = 3 THEN NULL ELSE o END AS op, h, l, lag(c) OVER {W} AS pc FROM b), r AS (SELECT *, op / nullif(pc, 0) AS q, {NOISE} AS u FROM x), "
    "g AS (SELECT avg(q) AS m, median(q) AS md, stddev_samp(q) AS s FROM r), k AS (SELECT secu, avg(q) AS own, stddev_samp(q) AS own_s FROM r GROUP BY secu) "
    "SELECT secu, d, " + ", ".join(f"round({e}, 5) + 0.0 AS {n}" for n, e in OPENING.items()) + " FROM r JOIN k USING (secu), g WHERE op IS NULL"
)
def opening_estimates(spark, sf):
    df = flag_bars(spark, sf).withColumns({"pc": P.lag("c"), "op": F.when(F.dayofmonth("d") % 7 != 3, F.col("o"))})
    return rounded(opening.opening_estimates(df, ["secu", "d"], "op", "pc", "secu", "l", "h").select("secu", "d", *OPENING), 5)


LISTED = "lst AS (SELECT s_suppkey AS secu, CAST(DATE '1994-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) AS DATE) AS listed, CAST(s_nationkey % 3 AS INTEGER) AS sector FROM supplier)"


@query(f"WITH {MONTH_BARS}, {LISTED} SELECT b.secu, b.d, lst.sector, CAST(b.d - lst.listed AS INTEGER) AS days_listed, round(x.c * 1.1, 4) + 0.0 AS ceiling, CAST(y.halted AS INTEGER) AS halted FROM b JOIN lst ON lst.secu = b.secu LEFT JOIN b x ON x.secu = b.secu AND x.d = b.d AND month(x.d) % 2 = 0 LEFT JOIN (SELECT secu, d, 1 AS halted FROM b WHERE n = 1) y ON y.secu = b.secu AND y.d = b.d WHERE lst.listed BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND b.d BETWEEN lst.listed AND DATE '1996-12-31'")
def new_listing_scan(spark, sf):
    b = month_bars(spark, sf)
    listed = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("secu"), F.date_add(F.lit("1994-01-01").cast("date"), (F.col("s_suppkey") * 37 % 1500).cast("int")).alias("listed"), (F.col("s_nationkey") % 3).cast("int").alias("sector"))
    limits = b.where("month(d) % 2 = 0").select("secu", "d", (F.col("c") * 1.1).alias("ceiling"))
    halted = b.where("n = 1").select("secu", "d", F.lit(1).alias("halted"))
    got = joins.new_listings(b.select("secu", "d"), listed, limits, halted, "secu", "d", "listed", "1995-01-01", "1996-12-31")
    return rounded(got.select("secu", "d", "sector", "days_listed", "ceiling", "halted"), 4)


FILED = "fil AS (SELECT secu, min(d) AS published, max(c) AS eps FROM b WHERE month(d) <= 6 GROUP BY secu, year(d))"


def _filed(b):
    return b.where("month(d) <= 6").groupBy("secu", F.year("d").alias("y")).agg(F.min("d").alias("published"), F.max("c").alias("eps")).drop("y")


@query(f"WITH {MONTH_BARS}, {FILED}, q AS (SELECT secu, d FROM b WHERE year(d) <= 1996) SELECT q.secu, q.d, fil.published, round(fil.eps, 4) + 0.0 AS eps FROM q LEFT JOIN fil ON fil.secu = q.secu AND q.d >= fil.published")
def filings_so_far(spark, sf):
    b = month_bars(spark, sf)
    return rounded(joins.since(b.where("year(d) <= 1996").select("secu", "d"), _filed(b), ["secu"], "d", "published"), 4)


@query(f"WITH {MONTH_BARS}, {FILED}, v AS (SELECT DISTINCT d FROM b WHERE year(d) = 1995 AND month(d) IN (2, 3)), x AS (SELECT secu, published, CAST(published + INTERVAL 1 MONTH AS DATE) AS due FROM fil) SELECT * FROM x WHERE published IN (SELECT d FROM v) OR due IN (SELECT d FROM v)")
def filings_on_either_day(spark, sf):
    b = month_bars(spark, sf)
    days = b.where("year(d) = 1995 and month(d) in (2, 3)").select("d")
    return joins.either(_filed(b).select("secu", "published", F.add_months("published", 1).alias("due")), ["published", "due"], days, "d")


@query(f"WITH {MONTH_BARS}, f AS (SELECT secu, CAST(d + INTERVAL 1 MONTH AS DATE) AS published, d AS period, c AS eps FROM b), i AS (SELECT s_suppkey AS secu, s_nationkey AS industry FROM supplier), m AS (SELECT industry, d AS published, avg(c) AS multiple FROM b JOIN i USING (secu) WHERE secu % 2 = 0 GROUP BY 1, 2), p AS (SELECT secu, d AS period, h AS forecast FROM b WHERE secu % 3 = 0) SELECT f.secu, industry, f.published, f.period, round(eps, 4) + 0.0 AS eps, round(multiple, 4) + 0.0 AS multiple, round(forecast, 4) + 0.0 AS forecast FROM f JOIN i USING (secu) LEFT JOIN m USING (industry, published) LEFT JOIN p USING (secu, period) WHERE f.period = DATE '1995-06-01'")
def filing_financials(spark, sf):
    b = month_bars(spark, sf)
    industries = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("secu"), F.col("s_nationkey").alias("industry"))
    filings = b.select("secu", F.add_months("d", 1).alias("published"), F.col("d").alias("period"), F.col("c").alias("eps"))
    multiples = b.where("secu % 2 = 0").join(industries, "secu").groupBy("industry", F.col("d").alias("published")).agg(F.avg("c").alias("multiple"))
    forecasts = b.where("secu % 3 = 0").select("secu", F.col("d").alias("period"), F.col("h").alias("forecast"))
    return rounded(wh.financials(filings, industries, multiples, forecasts, "secu", "industry", "published", "period", "1995-06-01"), 4)


#: Six tables beside the quotes, by supplier and month: a condition, and what is summed.
PARTS = {"returned": ("l_returnflag = 'R'", "l_extendedprice"), "open_lines": ("l_linestatus = 'O'", "l_quantity"), "first_lines": ("l_linenumber = 1", "l_quantity"), "discounted": ("l_discount > 0.05", "l_extendedprice * l_discount"), "taxed": ("l_tax > 0.04", "l_extendedprice * l_tax"), "bulk": ("l_quantity > 40", "l_quantity")}
MONTH = "CAST(date_trunc('month', l_shipdate) AS DATE)"


@query(
    f"WITH {MONTH_BARS}, " + ", ".join(f"{n} AS (SELECT l_suppkey AS secu, {MONTH} AS d, sum({e}) AS {n} FROM lineitem WHERE {w} GROUP BY 1, 2)" for n, (w, e) in PARTS.items())
    + f" SELECT secu, d, round(c, 4) + 0.0 AS c, {', '.join(f'round({n}, 2) + 0.0 AS {n}' for n in PARTS)}, {', '.join(f'round(lead(c, {k}) OVER {W}, 4) + 0.0 AS Future_Return_{k}D' for k in (1, 5, 20))} FROM b "
    + " ".join(f"LEFT JOIN {n} USING (secu, d)" for n in PARTS)
)
def seven_tables(spark, sf):
    li = read(spark, sf, "lineitem").withColumns({"secu": F.col("l_suppkey"), "d": F.trunc(F.col("l_shipdate").cast("date"), "month")})
    parts = [li.where(w).groupBy("secu", "d").agg(F.sum(F.expr(e)).alias(n)) for n, (w, e) in PARTS.items()]
    got = wh.wide_table(month_bars(spark, sf).select("secu", "d", "c"), parts, ["secu", "d"], P, "c")
    return rounded(got, 4, **{n: 2 for n in PARTS})


@query(
    f"WITH {BARS}, x AS (SELECT secu, d, o, CASE WHEN day(d) = 9 THEN NULL ELSE c END AS c FROM b), j AS (SELECT o / lag(o) OVER {W} - 1 AS oo, c / lag(c) OVER {W} - 1 AS cc FROM x), t AS (SELECT stddev_samp(cc) AS s FROM j) "
    "SELECT 'columns' AS \"check\", false AS passed, 'close' AS found UNION ALL SELECT 'rows', count(*) > 0, CAST(count(*) AS VARCHAR) FROM x UNION ALL SELECT 'repeats', true, '0' UNION ALL SELECT 'missing', count(c) = count(*), CAST(round((count(*) - count(c)) / (count(*) * 4), 3) AS VARCHAR) FROM x "
    "UNION ALL SELECT 'dates', true, '0' UNION ALL SELECT 'jumps', count(*) = 0, CAST(count(*) AS VARCHAR) FROM (SELECT oo AS v FROM j UNION ALL SELECT cc FROM j) WHERE abs(v) > 0.5 UNION ALL SELECT 'target', NOT (s < 0.001), CAST(round(s, 3) AS VARCHAR) FROM t"
)
def validation_report(spark, sf):
    b = bars(spark, sf).select("secu", "d", "o", F.when(F.dayofmonth("d") != 9, F.col("c")).alias("c"))
    got = quality.validation_report(b, P, ["secu", "d", "close"], ["o", "c"], "c", "d")
    short = F.when(F.col("check").isin("missing", "target"), F.round(F.col("found").cast("double"), 3).cast("string")).otherwise(F.col("found"))
    return got.withColumn("found", short)


IC_YEARS = f"{MONTH_BARS}, x AS (SELECT secu, d, v AS a, amt AS z, lead(c) OVER {W} / c - 1 AS y FROM b), k AS (SELECT 'a' AS f, secu, d, a AS x, y FROM x UNION ALL SELECT 'z', secu, d, z, y FROM x), m AS (SELECT *, f || '|' || d AS g FROM k WHERE y IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM m), i AS (SELECT f AS feature, d, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic, count(*) AS n FROM r GROUP BY 1, 2)"


@query(f"WITH {IC_YEARS}, t AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY d) AS k FROM i WHERE n >= 3), s AS (SELECT feature, count(ic) AS periods, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS icir, avg(CASE WHEN round(ic, 12) > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS positive_ratio, regr_slope(ic, k) AS trend FROM t GROUP BY feature) SELECT feature, periods, round(ic_mean, 6) + 0.0 AS ic_mean, round(ic_std, 6) + 0.0 AS ic_std, round(icir, 6) + 0.0 AS icir, round(positive_ratio, 6) + 0.0 AS positive_ratio, round(trend, 6) + 0.0 AS trend, CASE WHEN abs(icir) > 1 THEN 'strong' WHEN abs(icir) > 0.5 THEN 'stable' WHEN abs(icir) > 0.2 THEN 'weak' ELSE 'unstable' END AS grade FROM s")
def stability_report(spark, sf):
    m = month_bars(spark, sf).withColumns({"a": F.col("v").cast("double"), "z": F.col("amt").cast("double"), "y": F.try_divide(P.lead("c"), "c") - 1})
    long = research.unpivoted(m.select("secu", "d", "a", "z", "y"), ["secu", "d", "y"], ["a", "z"])
    return rounded(research.stability_report(research.rank_ic(long, ["feature", "d"], "value", "y"), ["feature"], "d"))


@query()
def technical_group(spark, sf):
    """The whole group; its members have SQL of their own."""
    return rounded(technical.all_technical(bars(spark, sf), P, B, "d"), 4)


@query()
def volume_group(spark, sf):
    return rounded(volume.volume_features(bars(spark, sf), P, B), 4)


@query()
def elimination(spark, sf):
    """The two features that recursive elimination keeps."""
    return spark.createDataFrame([(c,) for c in model.eliminated(frame(spark, sf), FEATURES, 2)], "feature string")


@query("WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT min(d) AS a, max(d) AS b FROM o), m AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', a) AS DATE), b, INTERVAL 1 MONTH)) AS DATE) AS m FROM s), r AS (SELECT m, greatest(m, a) AS start, least(last_day(m), b) AS \"end\" FROM m, s) SELECT CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, start, \"end\", count(o.d) AS orders FROM r LEFT JOIN o ON o.d BETWEEN start AND \"end\" GROUP BY m, start, \"end\"")
def month_ranges(spark, sf):
    """The months of the orders' time, clipped to it, and the orders in each."""
    days = read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    first, last = days.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    per = days.groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(F.count("*").alias("orders"))
    return tables.month_ranges(spark, first, last).join(per, ["year", "month"], "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query(f"WITH {FLAG_BARS} SELECT secu, d, round(CASE WHEN count(c) OVER {R(5)} = 5 THEN (max(c) OVER {R(5)} - min(c) OVER {R(5)}) / avg(c) OVER {R(5)} END, 6) + 0.0 AS spread FROM b")
def user_function(spark, sf):
    """A user's function over rolling windows."""
    df = flag_bars(spark, sf)
    return rounded(df.select("secu", "d", rolling_apply(P, "c", 5, lambda v: (v.max() - v.min()) / v.mean()).alias("spread")))


@query(SUSPEND + ' SELECT "InnerCode", "SecuCode", "SuspendDate", "ResumptionDate", "InfoSource", "SuspendReason" FROM susp')
def suspension_round_trip(spark, sf):
    """Written as JSON texts and read back."""
    return relational.suspensions_from_documents(relational.suspension_documents(suspensions_of(spark, sf), SOURCES))


@query()
def fundamental_group(spark, sf):
    df = month_bars(spark, sf).select("secu", "d", F.col("c").alias("PE"), F.col("o").alias("PB"), F.col("amt").cast("double").alias("Revenue"))
    return rounded(fundamental.fundamental_features(df, P, ["PE", "PB"], ["Revenue"], ["d"]), 4)


@query()
def model_summary(spark, sf):
    return rounded(model.summary(spark, model.fitted(frame(spark, sf), FEATURES, "ridge"), FEATURES), 4)
