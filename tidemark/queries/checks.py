"""Cleaning chains, scores of predictions, scans for checks and reports of what they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, joins, market, model, orderbook, quality, research
from .audit import AUDIT, HOLES, ISSUES, RUN, _audited, broken, holes
from .base import BARS, MONTH_BARS, P, R, W, bars, lag, month_bars, query, read, rounded, steps
from .books import BOOK, L1, book
from .tables import QUOTES, warehouse

DIRT = """r AS (SELECT CASE WHEN k % 50 <> 7 THEN k END AS k, CASE WHEN k % 50 <> 7 THEN CASE WHEN k % 9 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END END AS trade_date, CASE WHEN k % 50 <> 7 THEN CASE WHEN k % 8 = 0 THEN 'none' ELSE CAST(k % 1000 AS VARCHAR) || '.5' END END AS close_price FROM (SELECT o_orderkey AS k, o_orderdate FROM orders))"""


def dirt(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").cast("string").alias("d"))
    k = F.col("k")
    o = o.select(F.when(k % 50 != 7, k).alias("k"), F.when(k % 50 != 7, F.when(k % 9 == 0, "n/a").otherwise(F.col("d"))).alias("trade_date"), F.when(k % 50 != 7, F.when(k % 8 == 0, "none").otherwise(F.concat((k % 1000).cast("string"), F.lit(".5")))).alias("close_price"), F.lit(None).cast("string").alias("remark"))
    return o.union(o.where(k % 3 == 0))


@query(f"WITH {DIRT} SELECT DISTINCT k, TRY_CAST(trade_date AS DATE) AS trade_date, round(TRY_CAST(close_price AS DOUBLE), 6) + 0.0 AS close_price FROM r WHERE k IS NOT NULL")
def rows_cleaned(spark, sf):
    """Orders as text, a third of them twice, some without anything, and a column without values."""
    return rounded(clean.cleaned(dirt(spark, sf)))


@query(f"WITH {DIRT}, u AS (SELECT *, CAST(k % 1000 AS DOUBLE) AS whole, CAST(k AS DOUBLE) / 7 AS part FROM r WHERE k IS NOT NULL) SELECT 'k' AS column_name, 'as it is' AS kind UNION ALL SELECT 'whole', CASE WHEN bool_and(whole % 1 = 0) THEN 'integer' ELSE 'as it is' END FROM u UNION ALL SELECT 'part', CASE WHEN bool_and(part % 1 = 0) THEN 'integer' ELSE 'as it is' END FROM u UNION ALL SELECT 'trade_date', CASE WHEN count(DISTINCT trade_date) / count(*) < 0.5 THEN 'category' ELSE 'as it is' END FROM u UNION ALL SELECT 'close_price', CASE WHEN count(DISTINCT close_price) / count(*) < 0.5 THEN 'category' ELSE 'as it is' END FROM u")
def column_kinds(spark, sf):
    d = dirt(spark, sf).where("k IS NOT NULL").drop("remark").distinct()
    return clean.column_types(d.withColumns({"whole": (F.col("k") % 1000).cast("double"), "part": F.col("k").cast("double") / 7}))


AHEAD = "(PARTITION BY secu ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
GONE = HOLES + ", y AS (SELECT secu, d, CASE WHEN secu = 2 THEN NULL ELSE c END AS c, v FROM x)"


@query(f"WITH {GONE}, f AS (SELECT secu, d, " + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER {RUN}, first_value({c} IGNORE NULLS) OVER {AHEAD}) AS {c}" for c in "cv") + " FROM y) SELECT secu, d, round(c, 6) + 0.0 AS c, round(v, 6) + 0.0 AS v FROM f")
def gaps_handled(spark, sf):
    """Forward, backward, mean; one series has no close at all and keeps none."""
    df = holes(spark, sf).select("secu", "d", F.when(F.col("secu") != 2, F.col("c")).alias("c"), "v")
    return rounded(clean.missing_handled(df, P, ["c", "v"]))


def _clip(c: str) -> str:
    return f"least(greatest({c}, q.{c}[1] - 1.5 * (q.{c}[2] - q.{c}[1])), q.{c}[2] + 1.5 * (q.{c}[2] - q.{c}[1])) AS {c}"


PX = BARS + ", x AS (SELECT secu, d, o, h, l, CASE WHEN day(d) % 7 <> 3 THEN c END AS c, CASE WHEN day(d) % 5 <> 1 THEN v END AS v FROM b)"


@query(f"""WITH {PX}, f AS (SELECT secu, d, {", ".join(f"last_value({c} IGNORE NULLS) OVER {RUN} AS {c}" for c in "ohlc")}, coalesce(v, 0) AS v FROM x), q AS (SELECT {", ".join(f"quantile_cont({c}, [0.25, 0.75]) AS {c}" for c in "ohlcv")} FROM f), k AS (SELECT f.secu, f.d, {", ".join(f"CASE WHEN f.{c} IS NOT NULL THEN " + _clip(c).replace(f"greatest({c},", f"greatest(f.{c},").replace(f" AS {c}", f" END AS {c}") for c in "ohlcv")} FROM f, q)
SELECT secu, d, round(o, 5) + 0.0 AS o, round(greatest(h, o, c), 5) + 0.0 AS h, round(least(l, o, c), 5) + 0.0 AS l, round(c, 5) + 0.0 AS c, round(v, 5) + 0.0 AS v FROM k""")
def bars_prepared(spark, sf):
    """The whole chain before features: prices forward, volume zero, quartile clip, consistent highs and lows."""
    day = F.dayofmonth("d")
    df = bars(spark, sf).select("secu", "d", "o", "h", "l", F.when(day % 7 != 3, F.col("c")).alias("c"), F.when(day % 5 != 1, F.col("v")).alias("v"))
    return rounded(clean.prepared(df, P, "o", "h", "l", "c", "v"), 5)


@query(f"""WITH {MONTH_BARS}, x AS (SELECT secu, d, CASE WHEN month(d) NOT IN (3, 4) THEN c END AS c, CASE WHEN month(d) <> 5 THEN v END AS v FROM b), m AS (SELECT median(c) AS c, median(v) AS v FROM x), f AS (SELECT secu, d, coalesce(x.c, m.c) AS c, coalesce(x.v, m.v) AS v FROM x, m), s AS (SELECT avg(c) AS cm, stddev_pop(c) AS cs, avg(v) AS vm, stddev_pop(v) AS vs FROM f)
SELECT secu, d, round((c - cm) / nullif(cs, 0), 6) + 0.0 AS c, round((v - vm) / nullif(vs, 0), 6) + 0.0 AS v FROM f, s""")
def features_finished(spark, sf):
    """Infinite and missing values to the median, a nearly constant column dropped, the others scaled."""
    m = F.month("d")
    c = F.when(m == 3, F.lit(float("inf"))).when(m == 4, F.lit(float("nan"))).otherwise(F.col("c"))
    df = month_bars(spark, sf).select("secu", "d", c.alias("c"), F.when(m != 5, F.col("v")).alias("v"), (F.col("c") / 1e9).alias("flat"))
    return rounded(clean.finished(df, ["c", "v", "flat"], scale=True))


@query(f"""WITH {HOLES}, m AS (SELECT avg(c) AS c, avg(v) AS v FROM x), f AS (SELECT coalesce(x.c, m.c) AS c, coalesce(x.v, m.v) AS v FROM x, m)
SELECT 'c' AS column_name, count_if(c IS NULL) AS missing_before, CAST(0 AS BIGINT) AS missing_after, round((SELECT avg(c) FROM f) - avg(c), 5) + 0.0 AS mean_change, round((SELECT stddev_samp(c) FROM f) - stddev_samp(c), 5) + 0.0 AS std_change FROM x
UNION ALL SELECT 'v', count_if(v IS NULL), CAST(0 AS BIGINT), round((SELECT avg(v) FROM f) - avg(v), 5) + 0.0, round((SELECT stddev_samp(v) FROM f) - stddev_samp(v), 5) + 0.0 FROM x""")
def imputation_changes(spark, sf):
    x = holes(spark, sf).select("c", "v")
    return rounded(clean.imputation_report(x, clean.imputed(x, ["c", "v"], "mean"), ["c", "v"]), 5)


@query(f"WITH {HOLES}, y AS (SELECT b.secu, b.d, b.o, b.h, b.l, x.amt FROM b JOIN x ON b.secu = x.secu AND b.d = x.d), m AS (SELECT avg(amt) AS a FROM y) SELECT secu, d, round(coalesce(amt, a), 4) + 0.0 AS amt FROM y, m")
def gaps_by_share_few(spark, sf):
    """Under a twentieth of all cells is missing: means."""
    df = bars(spark, sf).select("secu", "d", "o", "h", "l", F.when(F.dayofmonth("d") % 11 != 3, F.col("amt")).alias("amt"))
    return rounded(clean.auto_imputed(df, P, ["o", "h", "l", "amt"]).select("secu", "d", "amt"), 4)


def _line(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL OR {c}q IS NULL THEN {c}p WHEN {c}p IS NOT NULL THEN {c}p + ({c}q - {c}p) * (CAST(n - {c}a AS DOUBLE) / nullif({c}z - {c}a, 0)) END"


_ENDS = ", ".join(f"last_value({c} IGNORE NULLS) OVER {RUN} AS {c}p, first_value({c} IGNORE NULLS) OVER {AHEAD} AS {c}q, last_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER {RUN} AS {c}a, first_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER {AHEAD} AS {c}z" for c in ("c", "v", "amt"))


@query(f"WITH {HOLES}, i AS (SELECT *, row_number() OVER {W} AS n FROM x), j AS (SELECT *, {_ENDS} FROM i) SELECT secu, d, round({_line('c')}, 5) + 0.0 AS c, round({_line('v')}, 5) + 0.0 AS v, round({_line('amt')}, 3) + 0.0 AS amt FROM j")
def gaps_by_share_some(spark, sf):
    """Between a twentieth and a fifth of all cells: lines within each series."""
    return rounded(clean.auto_imputed(holes(spark, sf), P, ["c", "v", "amt"]), 5, amt=3)


@query(f"WITH {BARS}, s AS (SELECT secu, c AS y, lag(c) OVER {W} AS p FROM b), e AS (SELECT secu, y, y - p AS e FROM s WHERE p IS NOT NULL) SELECT secu, count(*) AS n, round(avg(e * e), 5) + 0.0 AS mse, round(avg(abs(e)), 6) + 0.0 AS mae, round(sqrt(avg(e * e)), 6) + 0.0 AS rmse, round(1 - avg(e * e) / nullif(var_pop(y), 0), 6) + 0.0 AS r2 FROM e GROUP BY secu")
def prediction_scores(spark, sf):
    """How well a close tells the next."""
    df = bars(spark, sf).withColumn("before", P.lag("c"))
    return rounded(model.regression_scores(df, ["secu"], "c", "before"), mse=5)


@query(f"""WITH {BARS}, s AS (SELECT secu, CAST(c > o AS INT) AS y, lag(CAST(c > o AS INT)) OVER {W} AS p FROM b), k AS (SELECT secu, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(y = 1 AND p = 1) AS DOUBLE) AS tp, CAST(count_if(y = 0 AND p = 0) AS DOUBLE) AS tn, CAST(count_if(y = 0 AND p = 1) AS DOUBLE) AS fp, CAST(count_if(y = 1 AND p = 0) AS DOUBLE) AS fn FROM s WHERE p IS NOT NULL GROUP BY secu),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fp, 0), 0) AS r0 FROM k)
SELECT secu, CAST(n AS BIGINT) AS n, round((tp + tn) / n, 6) + 0.0 AS accuracy, round((p1 * (tp + fn) + p0 * (tn + fp)) / n, 6) + 0.0 AS weighted_precision, round((r1 * (tp + fn) + r0 * (tn + fp)) / n, 6) + 0.0 AS weighted_recall, round((coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) * (tp + fn) + coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) * (tn + fp)) / n, 6) + 0.0 AS weighted_f1, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round((r1 + r0) / 2, 6) + 0.0 END AS auc FROM r""")
def class_scores(spark, sf):
    """How well a rise of a day tells that of the next."""
    df = bars(spark, sf).withColumn("y", (F.col("c") > F.col("o")).cast("int"))
    return rounded(model.class_scores(df.withColumn("p", P.lag("y")), ["secu"], "y", "p"))


@query(steps({"p": f"1 / (1 + exp(-50 * (c / {lag('c')} - 1)))"}, {"signal": "CASE WHEN p > 0.6 THEN 1 WHEN p < 0.4 THEN -1 ELSE 0 END", "confidence": "abs(p - 0.5) * 2"}, {"strength": f"confidence * least(confidence, 0.8) * (1 + 0.2 * abs(sum(signal) OVER {R(5)}) / 5)"}, out=["p", "confidence", "strength"], keys="secu, d, signal"))
def signals_strength(spark, sf):
    """Signals of probabilities, and their strength by the last five."""
    df = research.probability_signals(bars(spark, sf).withColumn("p", 1 / (1 + F.exp(-50 * P.pct("c")))), "p")
    df = research.signal_strength(df.withColumn("position", F.least("confidence", F.lit(0.8))), P)
    return rounded(df.select("secu", "d", "signal", "p", "confidence", "strength"))


_SUM = ", ".join(f'round(arg_max("{c}", d), 6) + 0.0 AS "{c}_current", round(avg("{c}"), 6) + 0.0 AS "{c}_mean", round(stddev_samp("{c}"), 6) + 0.0 AS "{c}_std", round(max("{c}"), 6) + 0.0 AS "{c}_max", round(min("{c}"), 6) + 0.0 AS "{c}_min", round(arg_max("{c}", d) - arg_min("{c}", d), 6) + 0.0 AS "{c}_change"' for c in ("OFI", "Spread", "Total_Depth"))


@query(f"WITH {BOOK}, s AS (SELECT *, " + ", ".join(f'{e} AS "{k}"' for k, e in L1.items()) + f" FROM b) SELECT secu, {_SUM} FROM s GROUP BY secu")
def orderbook_facts(spark, sf):
    """Now, mean, deviation, extremes and change of imbalance, spread and depth."""
    return rounded(orderbook.summary(orderbook.imbalance(book(spark, sf)), P))


@query(QUOTES + """ SELECT q."InnerCode", q."TradingDay", round("ClosePrice", 6) + 0.0 AS "ClosePrice", round("PriceCeiling", 2) + 0.0 AS "PriceCeiling", round("PriceFloor", 2) + 0.0 AS "PriceFloor", p."Ifsuspend", s."SecuCode", s."SecuMarket"
FROM quotes q LEFT JOIN limits l ON l."InnerCode" = q."InnerCode" AND l."TradingDay" = q."TradingDay" LEFT JOIN perf p ON p."InnerCode" = q."InnerCode" AND p."TradingDay" = q."TradingDay" JOIN secu s ON s."InnerCode" = q."InnerCode" WHERE s."ListedState" = 1 AND q."TradingDay" BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
def quality_scan(spark, sf):
    got = joins.quality_scan(*warehouse(spark, sf), "InnerCode", "TradingDay", "1996-01-01", "1997-12-31")
    return rounded(got.select("InnerCode", "TradingDay", "ClosePrice", "PriceCeiling", "PriceFloor", "Ifsuspend", "SecuCode", "SecuMarket"), PriceCeiling=2, PriceFloor=2)


_FIELDS = [("c", "c = 0"), ("v", "v = 0 AND NOT susp")]


@query(f"WITH {AUDIT}, k AS (" + " UNION ALL ".join(f"SELECT CAST(year(d) AS INTEGER) AS y, '{c}' AS field, count(*) AS rows, count_if({c} IS NULL) AS nulls, count_if({z}) AS zeros, count_if({c} IN (-1, -999, -9999, 999, 9999, 99999)) AS placeholders, count_if({c} < 0) AS negatives FROM a GROUP BY 1" for c, z in _FIELDS) + ") SELECT *, " + ", ".join(f"round({n} * 100.0 / rows, 6) + 0.0 AS {n}_pct" for n in ("nulls", "zeros", "placeholders", "negatives")) + " FROM k")
def field_issues(spark, sf):
    return rounded(quality.field_issues(broken(spark, sf).withColumn("y", F.year("d")), ["c"], ["v"], F.col("susp"), ["y"]))


@query(f"WITH {AUDIT}, i AS (SELECT CAST(d - min(d) OVER (PARTITION BY secu) AS INTEGER) AS days, {ISSUES} AS s FROM a) SELECT days, count(*) AS rows, CAST(sum(len(string_split(s, '; '))) AS BIGINT) AS issues FROM i WHERE s <> '' GROUP BY days")
def issues_by_age(spark, sf):
    from pyspark.sql.window import Window

    df = _audited(spark, sf).withColumn("age", F.datediff("d", F.min("d").over(Window.partitionBy("secu"))))
    return quality.issues_by_age(df, "age")


@query(f"WITH {AUDIT}, i AS (SELECT secu, {ISSUES} AS s FROM a), e AS (SELECT secu, count(*) AS rows FROM i WHERE s <> '' GROUP BY 1), k AS (SELECT secu, count(DISTINCT string_split(x, ':')[1]) AS kinds FROM (SELECT secu, unnest(string_split(s, '; ')) AS x FROM i WHERE s <> '') GROUP BY 1) SELECT e.secu, rows, kinds FROM e JOIN k ON e.secu = k.secu ORDER BY rows DESC, e.secu LIMIT 3")
def most_issues(spark, sf):
    return quality.most_issues(_audited(spark, sf), "secu", 3)


MARKED = f"""{MONTH_BARS}, s AS (SELECT secu, d AS st, lead(d) OVER {W} AS en, month(d) AS m FROM b), q AS (SELECT b.secu, b.d, (c / lag(c) OVER {W} - 1) * 100 AS x, b.secu % 2 = 0 AND month(b.d) = 3 AS suspended_on, b.secu % 2 = 0 AND coalesce(month(lag(b.d) OVER {W}) = 3, false) AS resumed_on, b.secu % 3 = 0 AND month(b.d) = 6 AS factor_changed FROM b)"""


def _marked(spark, sf):
    b = month_bars(spark, sf)
    susp = b.select("secu", F.col("d").alias("SuspendDate"), P.lead("d").alias("ResumptionDate")).where("secu % 2 = 0 AND month(SuspendDate) = 3")
    factors = b.where("secu % 3 = 0 AND month(d) = 6").select("secu", F.col("d").alias("ExDiviDate"))
    return market.day_marks(b.select("secu", "d", (P.pct("c") * 100).alias("x")), susp, factors, "secu", "d")


_QS = {"q25": 0.25, "median": 0.5, "q75": 0.75}
_COUNTS = {"up": "x > 0", "down": "x < 0", "unchanged": "x = 0", "limit_up": "x >= 9.8", "limit_down": "x <= -9.8", "high": "x >= 8", "small": "abs(x) <= 1", "medium": "abs(x) > 1 AND abs(x) <= 5", "large": "abs(x) > 5 AND abs(x) < 9.8"}


@query(f"WITH {MARKED}, u AS (SELECT 'all' AS scope, * FROM q UNION ALL SELECT 'resumed', * FROM q WHERE resumed_on), m AS (SELECT *, CAST(date_trunc('month', d) AS DATE) AS month FROM u) SELECT scope, month, count(*) AS n, count(x) AS valid, " + ", ".join(f"round({f}(x), 6) + 0.0 AS {n}" for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("least", "min"), ("most", "max"))) + ", " + ", ".join(f"round(quantile_cont(x, {q}), 6) + 0.0 AS {n}" for n, q in _QS.items()) + ", " + ", ".join(f"count_if({c}) AS {n}" for n, c in _COUNTS.items()) + " FROM m GROUP BY GROUPING SETS ((scope, month), (scope))")
def change_review(spark, sf):
    """Changes by month and over all, of all quotes and of the days of resumption."""
    return rounded(market.change_review(_marked(spark, sf), "d", "x"))


@query(f"WITH {MARKED} SELECT secu, d, round(x, 6) + 0.0 AS x, coalesce(nullif(concat_ws(',', CASE WHEN suspended_on THEN 'suspended_on' END, CASE WHEN resumed_on THEN 'resumed_on' END, CASE WHEN factor_changed THEN 'factor_changed' END), ''), 'none') AS told FROM q WHERE x >= 8")
def large_moves(spark, sf):
    """Rises of 8 percent or more with what the day is marked as."""
    return rounded(market.large_moves(_marked(spark, sf), "x").select("secu", "d", "x", "told"))
