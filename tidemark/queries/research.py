"""Evaluation, selection, signals and back-test queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import research
from .base import BARS, MONTH_BARS, P, R, W, bars, lag, month_bars, query, roll, rounded, steps

RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM k)"
XY = f"{MONTH_BARS}, k0 AS (SELECT secu, d, {lag('v')} AS x, c / {lag('c')} - 1 AS y FROM b)"
RANK_IC = "count(*) AS n, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic"


def xy(spark, sf):
    return month_bars(spark, sf).select("secu", "d", P.lag("v").alias("x"), P.pct("c").alias("y"))


@query(f"WITH {XY}, k AS (SELECT d AS g, x, y FROM k0 WHERE x IS NOT NULL AND y IS NOT NULL), {RANKED}, i AS (SELECT g AS d, {RANK_IC} FROM r GROUP BY g) SELECT d, n, round(ic, 6) + 0.0 AS ic FROM i WHERE n >= 3")
def ic_spearman(spark, sf):
    return rounded(research.rank_ic(xy(spark, sf), ["d"], "x", "y"))


@query(f"WITH {XY}, k AS (SELECT date_trunc('quarter', d) AS g, x, y FROM k0 WHERE x IS NOT NULL AND y IS NOT NULL), {RANKED}, i AS (SELECT g, {RANK_IC} FROM r GROUP BY g HAVING count(*) >= 3), c AS (SELECT *, exp(sum(ln(greatest(1 + ic, 1e-12))) OVER (ORDER BY g ROWS UNBOUNDED PRECEDING)) AS c FROM i), dd AS (SELECT *, c / max(c) OVER (ORDER BY g ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c) SELECT count(*) AS periods, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) + 0.0 AS ic_std, round(avg(ic) / stddev_samp(ic), 6) + 0.0 AS icir, round(min(dd), 6) + 0.0 AS max_drawdown, round(avg(CAST(ic > 0 AS INT)), 6) + 0.0 AS positive_ratio FROM dd")
def icir_quarter(spark, sf):
    ics = research.rank_ic(xy(spark, sf).withColumn("q", F.trunc("d", "quarter")), ["q"], "x", "y")
    return rounded(research.stability(ics, "q").drop("stable"))


LAGS = (1, 3, 6)


@query(f"WITH {MONTH_BARS}, k0 AS (SELECT secu, d, v AS x, " + ", ".join(f"lead(c, {n}) OVER {W} / c - 1 AS y{n}" for n in LAGS) + " FROM b), k AS (" + " UNION ALL ".join(f"SELECT {n} AS g, x, y{n} AS y FROM k0 WHERE y{n} IS NOT NULL" for n in LAGS) + f"), {RANKED} SELECT CAST(g AS INTEGER) AS lag, n, round(ic, 6) + 0.0 AS ic FROM (SELECT g, {RANK_IC} FROM r GROUP BY g)")
def ic_decay(spark, sf):
    m = month_bars(spark, sf).select("v", *[(F.try_divide(P.lead("c", n), "c") - 1).alias(str(n)) for n in LAGS])
    long = m.unpivot(["v"], [str(n) for n in LAGS], "lag", "y").withColumn("lag", F.col("lag").cast("int"))
    return rounded(research.rank_ic(long, ["lag"], "v", "y"))


@query()
def ic_significance(spark, sf):
    """All columns, of two features; draws are seeded, but not SQL."""
    return rounded(research.significances(xy(spark, sf).withColumn("z", F.col("x") * F.col("x")), ["x", "z"], "y"))


@query(f"WITH {MONTH_BARS}, n AS (SELECT *, row_number() OVER {W} AS rn FROM b), p AS (SELECT a.secu, a.d, z.v AS x, z.c AS y FROM n a JOIN n z ON z.secu = a.secu AND z.rn BETWEEN a.rn - 12 AND a.rn - 1), k AS (SELECT secu || '|' || d AS g, secu, d, x, y FROM p), {RANKED}, i AS (SELECT secu, d, count(*) AS m, covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) AS ic FROM r GROUP BY secu, d) SELECT b.secu, b.d, round(CASE WHEN m >= 9.6 THEN ic END, 6) + 0.0 AS rolling_ic FROM b LEFT JOIN i ON i.secu = b.secu AND i.d = b.d")
def rolling_ic(spark, sf):
    return rounded(research.rolling_ic(month_bars(spark, sf), P, "v", "c", 12).select("secu", "d", "rolling_ic"))


@query(f"WITH {BARS}, r AS (SELECT o, v, c, lead(c) OVER {W} AS y FROM b), k AS (SELECT * FROM r WHERE y IS NOT NULL), s AS (SELECT count(*) AS n, corr(o, y) AS a, corr(v, y) AS z FROM k) SELECT 'o' AS feature, round(a * a * (n - 2) / (1 - a * a), 2) + 0.0 AS f FROM s UNION ALL SELECT 'v', round(z * z * (n - 2) / (1 - z * z), 2) + 0.0 FROM s")
def f_regression(spark, sf):
    return rounded(research.f_scores(bars(spark, sf).withColumn("y", P.lead("c")), ["o", "v"], "y"), 2)


FILTERS = f"""{BARS}, x AS (SELECT o, o * 0.5 + 1 AS o2, v, CASE WHEN day(d) > 12 THEN NULL ELSE v END AS w, 0.0 * v AS z, lead(c) OVER {W} AS y FROM b),
s AS (SELECT count(o) / count(*) AS no, count(w) / count(*) AS nw, var_samp(o) AS a, var_samp(o2) AS b, var_samp(v) AS c, var_samp(z) AS vz, corr(o, o2) AS ab, corr(o, v) AS ac, corr(o2, v) AS bc FROM x),
g1 AS (SELECT *, CASE WHEN abs(ab) > 0.95 THEN CASE WHEN a < b THEN 'o' ELSE 'o2' END ELSE '' END AS g1 FROM s),
g2 AS (SELECT *, CASE WHEN abs(ac) > 0.95 AND g1 <> 'o' THEN CASE WHEN a < c THEN 'o' ELSE 'v' END ELSE '' END AS g2 FROM g1),
g3 AS (SELECT *, CASE WHEN abs(bc) > 0.95 AND g1 <> 'o2' AND g2 <> 'v' THEN CASE WHEN b < c THEN 'o2' ELSE 'v' END ELSE '' END AS g3 FROM g2),
kept AS (SELECT f AS feature FROM g3, (VALUES ('o'), ('o2'), ('v'), ('w'), ('z')) t(f) WHERE f NOT IN (g1, g2, g3) AND CASE f WHEN 'w' THEN nw ELSE no END >= 0.5 AND CASE f WHEN 'z' THEN vz ELSE a END >= 0.01)"""


def _filters(spark, sf):
    b = bars(spark, sf).withColumn("y", P.lead("c"))
    return b.withColumns({"o2": F.col("o") * 0.5 + 1, "w": F.when(F.dayofmonth("d") <= 12, F.col("v")), "z": F.col("v") * 0.0})


@query(f"WITH {FILTERS} SELECT feature FROM kept")
def feature_filters(spark, sf):
    """w is mostly missing, z constant, and o moves with o2."""
    b, names = _filters(spark, sf), ["o", "o2", "v", "w", "z"]
    kept = research.correlation_filtered(b, research.variance_filtered(b, research.missing_filtered(b, names)))
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query(f"WITH {FILTERS}, r AS (SELECT feature, CASE feature WHEN 'o' THEN var_samp(o) WHEN 'o2' THEN var_samp(o2) ELSE var_samp(v) END AS worth FROM kept, x GROUP BY feature) SELECT feature FROM r QUALIFY row_number() OVER (ORDER BY worth DESC, feature) <= 1")
def selection_run(spark, sf):
    """Without a target: the filters, then the largest variance."""
    kept = research.selected(_filters(spark, sf), ["o", "o2", "v", "w", "z"], k=1)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query()
def mutual_information(spark, sf):
    return rounded(research.mutual_information(bars(spark, sf).withColumn("y", P.lead("c")), ["o", "h", "v"], "y"))


SIG = "CASE WHEN {0} > {1} THEN 1 WHEN {0} < {2} THEN -1 ELSE 0 END"


@query(steps({"p": f"tanh((c / {lag('c')} - 1) * 5)", "q": f"1 / (1 + exp(-(c / {lag('c')} - 1)))"}, {"signal": SIG.format("p", 0.3, -0.3), "confidence": "abs(p)", "position": "least(abs(p) * 0.5, 0.4)", "psig": SIG.format("q", 0.6, 0.4)}, out=["confidence", "position", "signal", "psig"], exact=("signal", "psig")))
def signals_threshold(spark, sf):
    df = bars(spark, sf).withColumns({"p": F.tanh(P.pct("c") * 5), "q": 1 / (1 + F.exp(-P.pct("c")))})
    df = research.threshold_signals(df, "p", 0.3, 0.5, 0.4)
    prob = research.probability_signals(df.select("secu", "d", "q"), "q").select("secu", "d", F.col("signal").alias("psig"))
    return rounded(df.join(prob, ["secu", "d"]).select("secu", "d", "confidence", "position", "signal", "psig"))


@query(steps({"held": f"list(c) OVER {R(60)}"}, {"rk": "CASE WHEN len(held) = 60 THEN (len(list_filter(held, lambda y: y < c)) + (len(list_filter(held, lambda y: y = c)) + 1) / 2) / 60 END"}, {"signal": SIG.format("rk", 0.8, 0.2), "confidence": "abs(rk - 0.5) * 2"}, out=["signal", "confidence"], exact=("signal",)))
def signals_percentile(spark, sf):
    return rounded(research.percentile_signals(bars(spark, sf), P, "c", 60).select("secu", "d", "signal", "confidence"))


@query(steps({"z": f"(c - ({roll('avg', 'c', 60)})) / nullif({roll('stddev_samp', 'c', 60)}, 0)"}, {"signal": SIG.format("z", 1.5, -1.5), "confidence": "CASE WHEN z IS NULL THEN 1.0 ELSE least(abs(z) / 3, 1.0) END"}, out=["signal", "confidence"], exact=("signal",)))
def signals_zscore(spark, sf):
    return rounded(research.zscore_signals(bars(spark, sf), P, "c", 60).select("secu", "d", "signal", "confidence"))


@query(steps({"a": "(c - o) / o", "e": "(h - c) / c", "g": "(c - l) / c"}, {"prediction": "(a + e + g) / 3"}, {"confidence": "1 / (1 + sqrt((power(a - prediction, 2) + power(e - prediction, 2) + power(g - prediction, 2)) / 3))", "signal": SIG.format("prediction", 0.1, -0.1), "position": "least(abs(prediction), 1.0)"}, {"strength": f"confidence * position * (1 + 0.2 * abs(sum(signal) OVER {R(5)}) / 5)"}, out=["prediction", "confidence", "signal", "strength"], exact=("signal",)))
def signals_ensemble(spark, sf):
    df = bars(spark, sf).withColumns({"a": (F.col("c") - F.col("o")) / F.col("o"), "e": (F.col("h") - F.col("c")) / F.col("c"), "g": (F.col("c") - F.col("l")) / F.col("c")})
    return rounded(research.signal_strength(research.ensemble_signals(df, ["a", "e", "g"], 0.1), P).select("secu", "d", "prediction", "confidence", "signal", "strength"))


RET = f"0.0001 * (c / {lag('c')} - 1)"
RUN = "(PARTITION BY secu ORDER BY d ROWS UNBOUNDED PRECEDING)"


def ret(spark, sf):
    """Damped returns, above -1 for sure."""
    return bars(spark, sf).select("secu", "d", "c", (0.0001 * P.pct("c")).alias("ret"))


@query(steps({"ret": RET, "signal": f"CASE WHEN c > {lag('c')} THEN 1 WHEN c < {lag('c')} THEN -1 ELSE 0 END"}, {"sr": f"coalesce(ret * lag(signal) OVER {W}, 0.0)"}, {"cum": f"exp(sum(ln(1 + sr)) OVER {RUN})", "vv": f"({roll('stddev_samp', 'sr', 20)}) * {math.sqrt(252)!r}"}, {"drawdown": f"cum / max(cum) OVER {RUN} - 1"}, {"controlled": "CASE WHEN drawdown < -0.2 THEN 0.0 ELSE signal * least(coalesce(0.15 / nullif(vv, 0), 1.0), 1.0) END"}, out=["sr", "drawdown", "controlled"]))
def risk_controls(spark, sf):
    df = ret(spark, sf).withColumn("signal", F.when(F.col("c") > P.lag("c"), 1).when(F.col("c") < P.lag("c"), -1).otherwise(0))
    return rounded(research.risk_controls(df, P).select("secu", "d", F.col("strategy_ret").alias("sr"), "drawdown", "controlled"))


@query(f"WITH {BARS}, s AS (SELECT secu, d, CASE WHEN c > {lag('c')} THEN 1 WHEN c < {lag('c')} THEN -1 ELSE 0 END AS signal FROM b) SELECT d, round(greatest(-1.0, least(1.0, sum(signal) * 1.0 / (SELECT count(DISTINCT secu) FROM b))), 6) + 0.0 AS position FROM s GROUP BY d")
def portfolio(spark, sf):
    df = bars(spark, sf).select("secu", "d", F.when(F.col("c") > P.lag("c"), 1).when(F.col("c") < P.lag("c"), -1).otherwise(0).alias("signal"))
    return rounded(research.portfolio(df, "d"))


CURVE = f"{BARS}, r0 AS (SELECT secu, d, {RET} AS ret FROM b), r AS (SELECT * FROM r0 WHERE ret IS NOT NULL), c AS (SELECT *, exp(sum(ln(1 + ret)) OVER {RUN}) AS cum FROM r), dd AS (SELECT *, cum / max(cum) OVER {RUN} - 1 AS drawdown FROM c)"
LOSS = f"f AS (SELECT *, CAST(ret < 0 AS INT) AS f FROM r0), g AS (SELECT *, row_number() OVER {W} - sum(coalesce(f, 0)) OVER {RUN} AS run FROM f), l AS (SELECT secu, run, min(d) AS start, max(d) AS \"end\", count(*) AS length FROM g WHERE f = 1 GROUP BY secu, run)"


@query(f"WITH {CURVE}, {LOSS}, p AS (SELECT secu, count(*) AS n, last(cum ORDER BY d) - 1 AS total_return, stddev_samp(ret) * sqrt(252.0) AS volatility, stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252.0) AS down, min(drawdown) AS max_drawdown, avg(CAST(ret > 0 AS INT)) AS win_rate, abs(avg(CASE WHEN ret > 0 THEN ret END) / avg(CASE WHEN ret < 0 THEN ret END)) AS profit_factor FROM dd GROUP BY secu), a AS (SELECT *, power(1 + total_return, 252.0 / n) - 1 AS annual_return FROM p) SELECT secu, n, round(total_return, 5) + 0.0 AS total_return, round(annual_return, 5) + 0.0 AS annual_return, round(volatility, 6) + 0.0 AS volatility, round(max_drawdown, 6) + 0.0 AS max_drawdown, round(win_rate, 6) + 0.0 AS win_rate, round(profit_factor, 6) + 0.0 AS profit_factor, round((annual_return - 0.03) / volatility, 4) + 0.0 AS sharpe, round((annual_return - 0.03) / down, 4) + 0.0 AS sortino, round(annual_return / abs(max_drawdown), 4) + 0.0 AS calmar, (SELECT max(length) FROM l WHERE l.secu = a.secu) AS max_consecutive_losses FROM a")
def performance(spark, sf):
    out = research.performance(ret(spark, sf), P).select("secu", "n", "total_return", "annual_return", "volatility", "max_drawdown", "win_rate", "profit_factor", "sharpe", "sortino", "calmar", "max_consecutive_losses")
    return rounded(out, total_return=5, annual_return=5, sharpe=4, sortino=4, calmar=4)


@query(f"WITH {CURVE}, m AS (SELECT *, avg(ret) OVER (PARTITION BY d) AS bm FROM r) SELECT secu, round(covar_samp(ret, bm) / var_samp(bm), 6) + 0.0 AS beta, round(avg(ret - bm) * sqrt(252.0) / stddev_samp(ret - bm), 6) + 0.0 AS information_ratio, round(avg(ret) * 252 - (0.03 + covar_samp(ret, bm) / var_samp(bm) * (avg(bm) * 252 - 0.03)), 6) + 0.0 AS alpha FROM m GROUP BY secu")
def benchmark_metrics(spark, sf):
    from pyspark.sql.window import Window

    df = ret(spark, sf).where("ret IS NOT NULL").withColumn("bm", F.avg("ret").over(Window.partitionBy("d")))
    return rounded(research.performance(df, P, benchmark="bm").select("secu", "beta", "information_ratio", "alpha"))


@query(f"WITH {CURVE}, v AS (SELECT *, {roll('stddev_samp', 'ret', 20)} AS v FROM r), u AS (SELECT *, lag(v) OVER {W} AS u FROM v), q AS (SELECT secu, quantile_cont(ret, 0.05) AS a, quantile_cont(ret, 0.01) AS z FROM r GROUP BY secu), m AS (SELECT secu, avg(ret) AS m FROM r GROUP BY secu) SELECT u.secu, round(any_value(a), 6) + 0.0 AS var_95, round(any_value(z), 6) + 0.0 AS var_99, round(avg(CASE WHEN ret <= a THEN ret END), 6) + 0.0 AS cvar_95, round(avg(CASE WHEN ret <= z THEN ret END), 6) + 0.0 AS cvar_99, round(avg(power(ret - m, 3)) / power(avg(power(ret - m, 2)), 1.5), 4) + 0.0 AS skewness, round(avg(power(ret - m, 4)) / power(avg(power(ret - m, 2)), 2) - 3, 4) + 0.0 AS kurtosis, round(corr(CASE WHEN u IS NOT NULL THEN v END, CASE WHEN v IS NOT NULL THEN u END), 6) + 0.0 AS vol_clustering FROM u JOIN q USING (secu) JOIN m USING (secu) GROUP BY u.secu")
def risk_metrics(spark, sf):
    return rounded(research.risk(ret(spark, sf), P).drop("tail_risk"), skewness=4, kurtosis=4)


@query(f"WITH {CURVE}, t AS (SELECT *, max(d) OVER (PARTITION BY secu) AS last FROM dd), f AS (SELECT *, CAST(drawdown < 0 AS INT) AS f FROM t), g AS (SELECT *, row_number() OVER {W} - sum(f) OVER {RUN} AS run FROM f) SELECT secu, min(d) AS start, max(d) AS \"end\", count(*) AS length, round(min(drawdown), 6) + 0.0 AS depth, CAST(max(d) < max(last) AS INTEGER) AS recovered FROM g WHERE f = 1 GROUP BY secu, run")
def drawdown_periods(spark, sf):
    return rounded(research.drawdowns(ret(spark, sf), P))


@query(f"WITH {CURVE}, {LOSS} SELECT secu, start, \"end\", length FROM l")
def loss_runs(spark, sf):
    return research.loss_runs(ret(spark, sf), P)


@query(f"WITH {BARS}, s AS (SELECT secu, d, CASE WHEN c > {lag('c')} THEN 1 WHEN c < {lag('c')} THEN -1 ELSE 0 END AS signal FROM b), t AS (SELECT *, CAST(coalesce(abs(signal - lag(signal) OVER {W}), 0) AS DOUBLE) AS ch FROM s), n AS (SELECT *, sum(CAST(ch > 0 AS INT)) OVER {RUN} AS run FROM t), h AS (SELECT secu, run, count(*) AS n FROM n WHERE signal <> 0 GROUP BY secu, run) SELECT t.secu, round(avg(ch), 6) + 0.0 AS turnover, round(sum(ch) * 0.001, 6) + 0.0 AS total_cost, round((SELECT avg(n) FROM h WHERE h.secu = t.secu), 6) + 0.0 AS mean_holding FROM t GROUP BY t.secu")
def turnover(spark, sf):
    df = bars(spark, sf).select("secu", "d", F.when(F.col("c") > P.lag("c"), 1).when(F.col("c") < P.lag("c"), -1).otherwise(0).alias("signal"))
    return rounded(research.turnover(df, P))


@query(f"WITH {CURVE}, k AS (SELECT secu, d, CASE WHEN count(ret) OVER {R(60)} = 60 THEN exp(sum(ln(1 + ret)) OVER {R(60)}) - 1 END AS rr, ({roll('stddev_samp', 'ret', 60)}) * sqrt(252.0) AS rv FROM r) SELECT secu, d, round(rr, 6) + 0.0 AS rolling_return, round(rv, 6) + 0.0 AS rolling_volatility, round((rr - 0.03 * 60 / 252) / nullif(rv * sqrt(60 / 252.0), 0), 4) + 0.0 AS rolling_sharpe FROM k")
def rolling_metrics(spark, sf):
    df = research.rolling_metrics(ret(spark, sf).where("ret IS NOT NULL"), P, n=60)
    return rounded(df.select("secu", "d", "rolling_return", "rolling_volatility", "rolling_sharpe"), rolling_sharpe=4)


@query(f"WITH {CURVE}, k AS (SELECT secu, d, row_number() OVER {W} AS rn, exp(sum(ln(1 + ret)) OVER (PARTITION BY secu ORDER BY d ROWS UNBOUNDED PRECEDING)) AS p FROM r), j AS (SELECT a.secu, a.d, z.p / max(z.p) OVER (PARTITION BY a.secu, a.d ORDER BY z.rn) - 1 AS dd FROM k a JOIN k z ON z.secu = a.secu AND z.rn BETWEEN a.rn - 59 AND a.rn) SELECT secu, d, round(CASE WHEN count(*) = 60 THEN min(dd) END, 6) + 0.0 AS rolling_drawdown FROM j GROUP BY secu, d")
def rolling_drawdown(spark, sf):
    return rounded(research.rolling_metrics(ret(spark, sf).where("ret IS NOT NULL"), P, n=60).select("secu", "d", "rolling_drawdown"))


@query(steps({"y": f"lead(c, 5) OVER {W} / nullif(c, 0) - 1"}, {"up": "CAST(coalesce(y > 0, false) AS INTEGER)"}, out=["y", "up"], exact=("up",)))
def target_lead(spark, sf):
    df = bars(spark, sf).withColumn("y", F.try_divide(P.lead("c", 5), "c") - 1)
    return rounded(df.select("secu", "d", "y", F.coalesce(F.col("y") > 0, F.lit(False)).cast("int").alias("up")))


@query(f"WITH {BARS}, s AS (SELECT secu, d, CASE WHEN c > {lag('c')} THEN 1 WHEN c < {lag('c')} THEN -1 ELSE 0 END AS signal, h / l AS conf FROM b) SELECT secu, count(*) AS total, count_if(signal = 1) AS buys, count_if(signal = -1) AS sells, count_if(signal = 0) AS holds, round(avg(conf), 6) + 0.0 AS mean_confidence FROM s GROUP BY secu")
def signal_statistics(spark, sf):
    df = bars(spark, sf).select("secu", "d", F.when(F.col("c") > P.lag("c"), 1).when(F.col("c") < P.lag("c"), -1).otherwise(0).alias("signal"), (F.col("h") / F.col("l")).alias("confidence"))
    return rounded(research.signal_statistics(df, ["secu"]))
