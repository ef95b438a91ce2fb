"""The cookbook's queries on the derived fixtures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import research
from ..operators import warehouse as wh
from .base import BARS, MONTH_BARS, NUDGE, P, W, bars, lag, log, month_bars, query, read, rounded, steps


def fr(n: int) -> str:
    return f"(PARTITION BY secu ORDER BY d ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


@query(f"WITH {BARS}, t AS (SELECT secu, d, h - l AS spread FROM b WHERE day(d) <> 2), f AS (SELECT secu, d, amt AS flow FROM b WHERE day(d) <> 3) SELECT b.secu, b.d, round(c, 6) + 0.0 AS c, round(spread, 6) + 0.0 AS spread, round(flow, 2) + 0.0 AS flow FROM b LEFT JOIN t ON t.secu = b.secu AND t.d = b.d LEFT JOIN f ON f.secu = b.secu AND f.d = b.d WHERE c > 0 AND v > 10")
def joined_quotes(spark, sf):
    b = bars(spark, sf)
    t = b.where("day(d) <> 2").select("secu", "d", (F.col("h") - F.col("l")).alias("spread"))
    f = b.where("day(d) <> 3").select("secu", "d", F.col("amt").alias("flow"))
    return rounded(wh.joined_quotes(b.where("v > 10"), t, f, ["secu", "d"], "c", "v").select("secu", "d", "c", "spread", "flow"), flow=2)


@query(steps({"r": log(f"(c / {lag('c')})"), "t": f"greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))"}, {"vol_20": f"stddev_pop(c) OVER {fr(19)}", "vol_60": f"stddev_pop(c) OVER {fr(59)}", "ret_vol_20": f"stddev_pop(r) OVER {fr(19)}", "atr_14": f"avg(t) OVER {fr(13)}"}, out=["vol_20", "vol_60", "ret_vol_20", "atr_14"]))
def volatility_block(spark, sf):
    return rounded(wh.volatility_block(bars(spark, sf), P, "h", "l", "c").select("secu", "d", "vol_20", "vol_60", "ret_vol_20", "atr_14"))


@query(steps({"ma5": f"avg(c) OVER {fr(4)}", "ma20": f"avg(c) OVER {fr(19)}", "ma60": f"avg(c) OVER {fr(59)}", "hi": f"max(h) OVER {fr(59)}", "lo": f"min(l) OVER {fr(59)}", "momentum_5": f"c / {lag('c', 5)} - 1", "momentum_20": f"c / {lag('c', 20)} - 1"}, {"position_60": "(c - lo) / nullif(hi - lo, 0)"}, out=["ma5", "ma20", "ma60", "position_60", "momentum_5", "momentum_20"]))
def trend_block(spark, sf):
    return rounded(wh.trend_block(bars(spark, sf), P, "h", "l", "c").select("secu", "d", "ma5", "ma20", "ma60", "position_60", "momentum_5", "momentum_20"))


@query(f"WITH {MONTH_BARS}, s AS (SELECT b.*, s_nationkey AS sector FROM b JOIN supplier ON s_suppkey = secu) SELECT secu, d, CAST(rank() OVER (PARTITION BY sector, d ORDER BY c DESC) AS INTEGER) AS sector_rank, round(percent_rank() OVER (PARTITION BY sector, d ORDER BY c), 6) + 0.0 AS sector_pct, round(c / nullif(avg(c) OVER (PARTITION BY sector, d), 0), 6) + 0.0 AS relative FROM s")
def sector_rank(spark, sf):
    s = month_bars(spark, sf).join(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("secu"), F.col("s_nationkey").alias("sector")), "secu")
    return rounded(wh.sector_ranks(s, "d", "sector", "c").select("secu", "d", "sector_rank", "sector_pct", "relative"))


@query(steps({"conversion_value": "100.0 * c / nullif(o, 0)", "ma": f"avg(h) OVER {fr(20)}"}, {"premium": '(h / nullif("conversion_value", 0) - 1) * 100', "price_to_ma": "h / nullif(ma, 0)"}, {"option_proxy": f"{math.sqrt(2 * math.pi)!r} * abs(premium) / 100"}, out=["conversion_value", "premium", "option_proxy", "price_to_ma"]))
def convertible_bonds(spark, sf):
    return rounded(wh.bond_block(bars(spark, sf), P, "h", "c", "o").select("secu", "d", "conversion_value", "premium", "option_proxy", "price_to_ma"))


@query(f"WITH {MONTH_BARS} SELECT secu, d, round(CASE WHEN v > 0 THEN amt / v END, 6) + 0.0 AS margin_ratio, round(amt - {lag('amt')}, 2) + 0.0 AS margin_change, round(amt / nullif(avg(amt) OVER {fr(20)}, 0), 6) + 0.0 AS margin_trend, round(percent_rank() OVER (PARTITION BY d ORDER BY round(amt, 2)), 6) + 0.0 AS margin_pct FROM b")
def margin_trend(spark, sf):
    b = month_bars(spark, sf)
    out = wh.margin_block(b, P, "amt", "v").drop("margin_pct")
    pct = wh.margin_block(b.withColumn("amt", F.round(F.col("amt") * NUDGE, 2)), P, "amt", "v").select("secu", "d", "margin_pct")
    return rounded(out.join(pct, ["secu", "d"]).select("secu", "d", "margin_ratio", "margin_change", "margin_trend", "margin_pct"), margin_change=2)


@query(f"WITH {MONTH_BARS}, t AS (SELECT l_suppkey AS secu, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_extendedprice AS x, l_quantity AS q FROM lineitem WHERE l_quantity >= 45), p AS (SELECT secu, d, sum(x) AS x, sum(q) AS q, count(*) AS n FROM t GROUP BY secu, d) SELECT b.secu, b.d, round(p.x, 2) + 0.0 AS block_value, round(p.q, 2) + 0.0 AS block_volume, p.n AS block_count FROM b LEFT JOIN p ON p.secu = b.secu AND p.d = b.d")
def block_trade_join(spark, sf):
    t = read(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_suppkey").alias("secu"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("d"), "l_extendedprice", "l_quantity")
    return rounded(wh.with_block_trades(month_bars(spark, sf).select("secu", "d"), t, ["secu", "d"], "l_extendedprice", "l_quantity").select("secu", "d", "block_value", "block_volume", "block_count"), 2)


@query(steps({"ix": "avg(c) OVER (PARTITION BY d)"}, {f"alpha_{n}": f"c / {lag('c', n)} - ix / {lag('ix', n)}" for n in (5, 20)}, out=["alpha_5", "alpha_20"]))
def industry_alpha(spark, sf):
    from pyspark.sql.window import Window

    b = bars(spark, sf).withColumn("ix", F.avg("c").over(Window.partitionBy("d")))
    return rounded(wh.alpha_block(b, P, "c", "ix").select("secu", "d", "alpha_5", "alpha_20"))


@query(steps({"momentum": f"c / {lag('c', 20)} - 1", "dd": f"c / {lag('c')} - 1"}, {"strength": "momentum - avg(momentum) OVER (PARTITION BY d)", "momentum_rank": "CAST(rank() OVER (PARTITION BY d ORDER BY momentum DESC NULLS LAST) AS INTEGER)", "day_rank": "CAST(rank() OVER (PARTITION BY d ORDER BY dd DESC NULLS LAST) AS INTEGER)"}, out=["momentum", "strength", "momentum_rank", "day_rank"], exact=("momentum_rank", "day_rank")))
def industry_rotation(spark, sf):
    return rounded(wh.rotation_block(bars(spark, sf), P, "c").select("secu", "d", "momentum", "strength", "momentum_rank", "day_rank"))


@query(steps({"ch": f"(c / {lag('c')} - 1) * 100", "ma5": f"avg(c) OVER {fr(4)}", "spread": "h - l"}, {f"Future_Return_{n}D": f"lead(ch, {n}) OVER {W}" for n in (1, 5, 20)}, out=["ch", "ma5", "spread", *[f"Future_Return_{n}D" for n in (1, 5, 20)]]))
def wide_table(spark, sf):
    b = bars(spark, sf)
    base = b.select("secu", "d", (P.pct("c") * 100).alias("ch"))
    parts = [wh.trend_block(b, P, "h", "l", "c").select("secu", "d", "ma5"), b.select("secu", "d", (F.col("h") - F.col("l")).alias("spread"))]
    return rounded(wh.wide_table(base, parts, ["secu", "d"], P, "ch").select("secu", "d", "ch", "ma5", "spread", *[f"Future_Return_{n}D" for n in (1, 5, 20)]))


FEATS = f"""{MONTH_BARS}, x AS (SELECT secu, d, c / nullif({lag('c')}, 0) - 1 AS mom, v, lead(c) OVER {W} / c - 1 AS y FROM b), u AS (SELECT d, 'mom' AS feature, mom AS x, y FROM x UNION ALL SELECT d, 'v', v, y FROM x), k AS (SELECT d, feature, x, y FROM u WHERE x IS NOT NULL AND y IS NOT NULL),
ic AS (SELECT d, feature, count(*) AS n, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS ic FROM k GROUP BY d, feature HAVING count(*) >= 5)"""


def date_ics(spark, sf):
    x = month_bars(spark, sf).select("secu", "d", P.pct("c").alias("mom"), "v", (F.try_divide(P.lead("c"), "c") - 1).alias("y"))
    k = research.unpivoted(x, ["d", "y"], ["mom", "v"]).where("value IS NOT NULL AND y IS NOT NULL")
    return k.groupBy("d", "feature").agg(F.count("*").alias("n"), F.try_divide(F.covar_samp("value", "y"), F.stddev_samp("value") * F.stddev_samp("y")).alias("ic")).where("n >= 5")


@query(f"WITH {FEATS} SELECT feature, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) + 0.0 AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS icir, round(avg(CAST(abs(ic) > 0.05 AS INT)), 6) + 0.0 AS ic_share FROM ic GROUP BY feature")
def ic_summary(spark, sf):
    return rounded(research.ic_summary(date_ics(spark, sf), ["feature"]))


@query(f"WITH {FEATS} SELECT feature, CAST(year(d) AS INTEGER) AS y, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) + 0.0 AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS icir, round(avg(CAST(abs(ic) > 0.05 AS INT)), 6) + 0.0 AS ic_share FROM ic GROUP BY feature, year(d)")
def ic_stability(spark, sf):
    return rounded(research.ic_summary(date_ics(spark, sf).withColumn("y", F.year("d")), ["feature", "y"]))


@query(f"WITH {FEATS}, s AS (SELECT feature, avg(ic) / nullif(stddev_samp(ic), 0) AS icir FROM ic GROUP BY feature) SELECT feature, round(icir, 6) + 0.0 AS icir, CAST(rank() OVER (ORDER BY abs(icir) DESC) AS INTEGER) AS importance_rank FROM s WHERE abs(icir) > 0.001")
def importance_rank(spark, sf):
    return rounded(wh.ranked_features(research.ic_summary(date_ics(spark, sf), ["feature"]), 0.001).select("feature", "icir", "importance_rank"))


@query(f"WITH {BARS}, x AS (SELECT secu, CASE WHEN day(d) = 3 THEN NULL ELSE c END AS c, v FROM b) SELECT count(*) AS total, count(DISTINCT secu) AS distinct_keys, round(avg(CAST(c IS NULL AS INT)), 6) + 0.0 AS null_c, round(avg(CAST(v IS NULL AS INT)), 6) + 0.0 AS null_v FROM x")
def table_quality(spark, sf):
    x = bars(spark, sf).withColumn("c", F.when(F.dayofmonth("d") != 3, F.col("c")))
    return rounded(wh.table_quality(x, "secu", ["c", "v"]))


@query(f"WITH {BARS}, u AS (SELECT 'c' AS feature, c AS x FROM b UNION ALL SELECT 'v', v FROM b), s AS (SELECT feature, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max FROM u GROUP BY feature) SELECT s.feature, n, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(min, 6) + 0.0 AS min, round(max, 6) + 0.0 AS max, (SELECT count(*) FROM u WHERE u.feature = s.feature AND abs(u.x - s.mean) > 3 * s.std) AS outliers FROM s")
def feature_distribution(spark, sf):
    return rounded(wh.distribution(bars(spark, sf).select("c", "v"), ["c", "v"]))


@query(f"WITH {BARS} SELECT 'o' AS a, 'c' AS b, round(corr(o, c), 6) + 0.0 AS corr FROM b UNION ALL SELECT 'o', 'v', round(corr(o, v), 6) + 0.0 FROM b UNION ALL SELECT 'c', 'v', round(corr(c, v), 6) + 0.0 FROM b")
def corr_check(spark, sf):
    return rounded(research.correlations(bars(spark, sf), ["o", "c", "v"]))
