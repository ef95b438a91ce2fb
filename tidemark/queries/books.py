"""Order books, fundamentals, text and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.panel import Panel
from ..operators import alternative, fundamental, orderbook
from .base import NUDGE, P, R, W, bars, corr, lag, pct, query, read, roll, rounded, steps

K = "(event_id % 5)"
_cols = ", ".join(f"value - 0.01 * {k} * {K} AS \"Bid_Price{k}\", value + 0.01 * {k} * {K} AS \"Ask_Price{k}\", CAST((event_id * {k}) % 97 + 1 AS DOUBLE) AS \"Bid_Size{k}\", CAST((event_id * {k}) % 89 + 1 AS DOUBLE) AS \"Ask_Size{k}\"" for k in range(1, 6))
BOOK = f"b AS (SELECT event_type AS secu, event_id AS d, CAST(event_id % 1000 + 1 AS DOUBLE) AS v, {_cols} FROM events)"


def book(spark, sf):
    e = read(spark, sf, "events")
    k0 = F.col("event_id") % 5
    new = {}
    for k in range(1, 6):
        new |= {f"Bid_Price{k}": F.col("value") - 0.01 * k * k0, f"Ask_Price{k}": F.col("value") + 0.01 * k * k0, f"Bid_Size{k}": ((F.col("event_id") * k) % 97 + 1).cast("double"), f"Ask_Size{k}": ((F.col("event_id") * k) % 89 + 1).cast("double")}
    return e.withColumns(new).select(F.col("event_type").alias("secu"), F.col("event_id").alias("d"), (F.col("event_id") % 1000 + 1).cast("double").alias("v"), *new)


BS, AS_, BP, AP = '"Bid_Size1"', '"Ask_Size1"', '"Bid_Price1"', '"Ask_Price1"'
L1 = {"Mid_Price": f"({BP} + {AP}) / 2", "Spread": f"{AP} - {BP}", "OFI": f"({BS} - {AS_}) / nullif({BS} + {AS_}, 0)", "Bid_Ask_Ratio": f"{BS} / nullif({AS_}, 0)", "Total_Depth": f"{BS} + {AS_}"}
L2 = {"Spread_Ratio": '"Spread" / nullif("Mid_Price", 0)', "Price_Pressure": f'({AP} - "Mid_Price") / nullif("Spread", 0)'}


@query(steps(L1, L2, out=[*L1, *L2], source=BOOK))
def ofi_level1(spark, sf):
    return rounded(orderbook.imbalance(book(spark, sf)).select("secu", "d", *L1, *L2))


def _lv(k):
    return f'("Bid_Size{k}" - "Ask_Size{k}") / nullif("Bid_Size{k}" + "Ask_Size{k}", 0)'


LV = {f"OFI_Level_{k}": _lv(k) for k in range(1, 6)}
LC = {"Cumulative_OFI": " + ".join(f'coalesce("OFI_Level_{k}", 0)' for k in range(1, 6)), "Weighted_OFI": "(" + " + ".join(f'coalesce("OFI_Level_{k}", 0) / {k}' for k in range(1, 6)) + f") / {sum(1 / k for k in range(1, 6))!r}"}


@query(steps(LV, LC, out=[*LV, *LC], source=BOOK))
def ofi_levels(spark, sf):
    return rounded(orderbook.book_imbalance(book(spark, sf)).select("secu", "d", *LV, *LC))


MICRO = {"Volume_Weighted_Price_Impact": f"({roll('sum', 'rv', 20)}) / nullif({roll('sum', 'v', 20)}, 0)", "Price_Volatility": roll("stddev_samp", "r", 20), "Volume_Volatility": roll("stddev_samp", "v", 20), "Kyle_Lambda": f"({roll('avg', 'av', 20)}) / nullif({roll('avg', 'v2', 20)}, 0)", "Amihud_Illiquidity": roll("avg", "am", 20)}


@query(steps({"mid": f"({BP} + {AP}) / 2"}, {"r": pct("mid")}, {"rv": "r * v", "av": "abs(r) * v", "v2": "v * v", "am": "abs(r) / v", "Price_Impact": "r"}, MICRO, out=["Price_Impact", *MICRO], source=BOOK, digits=4, own={"Amihud_Illiquidity": 6}))
def microstructure(spark, sf):
    df = orderbook.microstructure(orderbook.imbalance(book(spark, sf)), P, volume="v")
    return rounded(df.select("secu", "d", "Price_Impact", *MICRO), 4, Amihud_Illiquidity=6)


@query(steps({"ofi": _lv(1), "n": f"CAST(row_number() OVER {W} AS DOUBLE)"}, {"OFI_MA": roll("avg", "ofi", 20), "OFI_Std": roll("stddev_samp", "ofi", 20), "OFI_Trend": f"CASE WHEN count(ofi) OVER {R(20)} = 20 THEN covar_pop(ofi, n) OVER {R(20)} / var_pop(n) OVER {R(20)} END", "Volume_OFI_Corr": corr("v", "ofi", 20)}, {"OFI_ZScore": '(ofi - "OFI_MA") / nullif("OFI_Std", 0)'}, out=["OFI_MA", "OFI_Std", "OFI_Trend", "Volume_OFI_Corr", "OFI_ZScore"], source=BOOK))
def order_flow_metrics(spark, sf):
    df = orderbook.flow_metrics(orderbook.imbalance(book(spark, sf)), P, "v")
    return rounded(df.select("secu", "d", "OFI_MA", "OFI_Std", "OFI_Trend", "Volume_OFI_Corr", "OFI_ZScore"))


@query(steps({"ofi": _lv(1), "mid": f"({BP} + {AP}) / 2"}, {"r": pct("mid")}, {"rv": "r * v", "orr": "ofi * r", "am": "abs(r) / v"}, {"Temporary_Impact": "orr", "Permanent_Impact": roll("avg", "rv", 20), "Impact_Coefficient": roll("avg", "am", 20), "Order_Flow_Impact": roll("avg", "orr", 20), "Impact_Volatility": roll("stddev_samp", "r", 20)}, out=["Temporary_Impact", "Permanent_Impact", "Impact_Coefficient", "Order_Flow_Impact", "Impact_Volatility"], source=BOOK, digits=4))
def market_impact(spark, sf):
    df = orderbook.market_impact(orderbook.imbalance(book(spark, sf)), P, volume="v")
    return rounded(df.select("secu", "d", "Temporary_Impact", "Permanent_Impact", "Impact_Coefficient", "Order_Flow_Impact", "Impact_Volatility"), 4)


LIQ = {"Effective_Spread": "2 * sp", "Relative_Spread": "sp / nullif(mid, 0)", "Liquidity_Ratio": "v / nullif(sp, 0)", "Liquidity_Index": "dep / nullif(sp, 0)", "Liquidity_Cost": "sp / nullif(dep, 0)", "Liquidity_Pressure": f"({AS_} - {BS}) / nullif(dep, 0)"}


@query(steps({"sp": f"round({AP} - {BP}, 6)", "mid": f"({BP} + {AP}) / 2", "dep": f"{BS} + {AS_}"}, LIQ, out=list(LIQ), source=BOOK, digits=2, own={"Relative_Spread": 6, "Liquidity_Cost": 6, "Liquidity_Pressure": 6}))
def liquidity(spark, sf):
    b = book(spark, sf).withColumn("Ask_Price1", F.col("Bid_Price1") + F.round((F.col("Ask_Price1") - F.col("Bid_Price1")) * NUDGE, 6))
    return rounded(orderbook.liquidity(b, P, "v").select("secu", "d", *LIQ), 2, Relative_Spread=6, Liquidity_Cost=6, Liquidity_Pressure=6)


@query()
def orderbook_summary(spark, sf):
    return rounded(orderbook.summary(orderbook.imbalance(book(spark, sf)), P))


FIN = """b AS (SELECT secu, d, sum(p) AS "Revenue", sum(CASE WHEN s = 'F' THEN p ELSE 0 END) * 0.1 AS "NetProfit" FROM (SELECT c_nationkey AS secu, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, o_totalprice AS p, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY secu, d)"""


def financials(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("secu"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("d")).agg(F.sum("o_totalprice").alias("Revenue"), (F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)) * 0.1).alias("NetProfit"))


GROW = {"Revenue_YoY": pct('"Revenue"', 12), "Revenue_QoQ": pct('"Revenue"', 3), "Revenue_MA4": roll("avg", '"Revenue"', 4), "Revenue_MA8": roll("avg", '"Revenue"', 8), "Revenue_Trend": f'("Revenue" - ({roll("avg", chr(34) + "Revenue" + chr(34), 4)})) / nullif({roll("stddev_samp", chr(34) + "Revenue" + chr(34), 4)}, 0)', "Revenue_Volatility": f'({roll("stddev_samp", chr(34) + "Revenue" + chr(34), 8)}) / nullif({roll("avg", chr(34) + "Revenue" + chr(34), 8)}, 0)'}


@query(steps(GROW, out=list(GROW), source=FIN, own={"Revenue_MA4": 2, "Revenue_MA8": 2}))
def growth(spark, sf):
    return rounded(fundamental.growth(financials(spark, sf), P, "Revenue", 12, 3, (4, 8)).select("secu", "d", *GROW), Revenue_MA4=2, Revenue_MA8=2)


@query(steps({"ta": roll("sum", '"Revenue"', 4)}, {"Profit_Margin": '"NetProfit" / nullif("Revenue", 0)', "Asset_Turnover": '"Revenue" / nullif(ta, 0)', "ROA": '"NetProfit" / nullif(ta, 0)'}, {f"{c}_MA": roll("avg", f'"{c}"', 4) for c in ("Profit_Margin", "Asset_Turnover", "ROA")}, out=["Profit_Margin", "Asset_Turnover", "ROA", "Profit_Margin_MA", "Asset_Turnover_MA", "ROA_MA"], source=FIN))
def margins(spark, sf):
    df = financials(spark, sf).withColumn("TotalAssets", P.total("Revenue", 4))
    return rounded(fundamental.margins(df, P, n=4).select("secu", "d", "Profit_Margin", "Asset_Turnover", "ROA", "Profit_Margin_MA", "Asset_Turnover_MA", "ROA_MA"))


@query(steps({"pe": "c / 10", "held": f"list(c / 10) OVER {R(60)}"}, {"pe_MA20": roll("avg", "pe", 20), "pe_MA60": roll("avg", "pe", 60)}, {"pe_Relative": 'pe / nullif("pe_MA20", 0)', "pe_Percentile": "CASE WHEN len(held) = 60 THEN (len(list_filter(held, lambda y: y < pe)) + (len(list_filter(held, lambda y: y = pe)) + 1) / 2) / 60 END"}, out=["pe_MA20", "pe_MA60", "pe_Relative", "pe_Percentile"]))
def valuation(spark, sf):
    return rounded(fundamental.valuation(bars(spark, sf).withColumn("pe", F.col("c") / 10), P, "pe", year=60).select("secu", "d", "pe_MA20", "pe_MA60", "pe_Relative", "pe_Percentile"))


@query(steps({"x": "o / 10", "y": "h / 10", "z": "l / 10"}, {"Valuation_Score": "((1 + CAST(y < x AS INT) + CAST(z < x AS INT) + (CAST(y = x AS INT) + CAST(z = x AS INT)) / 2) + (1 + CAST(x < y AS INT) + CAST(z < y AS INT) + (CAST(x = y AS INT) + CAST(z = y AS INT)) / 2) + (1 + CAST(x < z AS INT) + CAST(y < z AS INT) + (CAST(x = z AS INT) + CAST(y = z AS INT)) / 2)) / 9.0"}, {"Valuation_Score_MA": roll("avg", '"Valuation_Score"', 20)}, out=["Valuation_Score", "Valuation_Score_MA"]))
def valuation_score(spark, sf):
    return rounded(fundamental.valuation_score(bars(spark, sf), P, ["o", "h", "l"]).select("secu", "d", "Valuation_Score", "Valuation_Score_MA"))


@query(f"WITH {FIN} SELECT secu, d, round(\"Revenue\" - avg(\"Revenue\") OVER (PARTITION BY secu % 5, d), 2) + 0.0 AS rev_Excess, round(\"Revenue\" / nullif(avg(\"Revenue\") OVER (PARTITION BY secu % 5, d), 0), 6) + 0.0 AS rev_Ratio, round(\"Revenue\" / nullif(sum(\"Revenue\") OVER (PARTITION BY secu % 5, d), 0), 6) + 0.0 AS rev_Share FROM b")
def industry_relative(spark, sf):
    df = financials(spark, sf).withColumn("industry", F.col("secu") % 5)
    return rounded(fundamental.industry_relative(df, ["industry", "d"], "Revenue", "rev").select("secu", "d", "rev_Excess", "rev_Ratio", "rev_Share"), rev_Excess=2)


@query(steps({"ok": f"CAST(CAST(coalesce(abs({pct('c')}) < 0.2, false) AS INT) AS DOUBLE)"}, {"Price_Continuity": roll("avg", "ok", 20)}, {"Overall_Quality": '(3.0 + coalesce("Price_Continuity", 0)) / (3 + CAST("Price_Continuity" IS NOT NULL AS INT))'}, out=["Price_Continuity", "Overall_Quality"]))
def data_quality(spark, sf):
    return rounded(fundamental.quality(bars(spark, sf), P, "c", "v").select("secu", "d", "Price_Continuity", "Overall_Quality"))


# text

WORDS = ("the", "and", "with", "licensed", "stupid")
RULES = (("license", "licensed|license"), ("rude", "stupid|moron|scum"), ("contact", "@|\\+1"))


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(lower(coalesce(text, '')), '(?-u:\\b){w}(?-u:\\b)')) AS INTEGER) AS kw_{w}" for w in WORDS).replace("(?-u:\\b)", "\\b") + " FROM documents")
def keyword_counts(spark, sf):
    return alternative.keyword_counts(read(spark, sf, "documents").select("doc_id", "text"), "text", WORDS).drop("text")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '@|\\+1') THEN 'contact' WHEN regexp_matches(lower(coalesce(text, '')), 'stupid|moron|scum') THEN 'rude' WHEN regexp_matches(lower(coalesce(text, '')), 'licensed|license') THEN 'license' ELSE 'other' END AS event_type FROM documents")
def event_type(spark, sf):
    return read(spark, sf, "documents").select("doc_id", alternative.event_type("text", RULES).alias("event_type"))


@query("WITH w AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^a-z]+') AS w FROM documents), n AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and'))) AS p, len(list_filter(w, lambda x: x IN ('of', 'stupid'))) AS q FROM w) SELECT doc_id, round(coalesce(CAST(p - q AS DOUBLE) / nullif(p + q, 0), 0.0), 6) + 0.0 AS sentiment FROM n")
def sentiment(spark, sf):
    return rounded(read(spark, sf, "documents").select("doc_id", alternative.sentiment("text", ("the", "and"), ("of", "stupid")).alias("sentiment")))


@query(steps({"v_MA7": roll("avg", "v", 7), "v_Change": pct("v"), "amt_Change": pct("amt"), "v_c_Corr": corr("v", "c", 30), "Weather_Price_Corr": corr("h", "c", 30), "m": roll("avg", "h", 30), "s": roll("stddev_samp", "h", 30)}, {"Temp_Anomaly": "(h - m) / nullif(s, 0)"}, out=["v_MA7", "v_Change", "amt_Change", "v_c_Corr", "Temp_Anomaly", "Weather_Price_Corr"]))
def activity_and_weather(spark, sf):
    df = alternative.weather(alternative.activity(bars(spark, sf), P, "v", "amt", "c"), P, "h", "c")
    return rounded(df.select("secu", "d", "v_MA7", "v_Change", "amt_Change", "v_c_Corr", "Temp_Anomaly", "Weather_Price_Corr"))


@query(steps({"z": "(c - avg(c) OVER (PARTITION BY secu)) / nullif(stddev_pop(c) OVER (PARTITION BY secu), 0)", "u": "(v - min(v) OVER (PARTITION BY secu)) / nullif(max(v) OVER (PARTITION BY secu) - min(v) OVER (PARTITION BY secu), 0)", "c_diff2": f"c - {lag('c', 2)}", "c_log": "ln(c + 1e-8)", "c_div_v": "c / (v + 1e-8)", "c_mul_v": "c * v", "c_sub_v": "c - v"}, out=["z", "u", "c_diff2", "c_log", "c_div_v", "c_mul_v", "c_sub_v"], own={"c_mul_v": 4}))
def transforms(spark, sf):
    df = alternative.normalized(bars(spark, sf), P, ["c"]).withColumnRenamed("c_norm", "z")
    df = alternative.normalized(df, P, ["v"], "minmax").withColumnRenamed("v_norm", "u")
    df = alternative.interactions(alternative.logged(alternative.differenced(df, P, ["c"], 2), ["c"]), [("c", "v")])
    return rounded(df.select("secu", "d", "z", "u", "c_diff2", "c_log", "c_div_v", "c_mul_v", "c_sub_v"), c_mul_v=4)


@query("WITH e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderkey, CAST(len(list_filter(q, lambda x: x < o_totalprice)) AS INTEGER) AS qbin, CAST(len(list_filter([lo + (hi - lo) * 0.25, lo + (hi - lo) * 0.5, lo + (hi - lo) * 0.75], lambda x: x < o_totalprice)) AS INTEGER) AS wbin FROM orders, e")
def binning(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    o = alternative.binned(o, "o_totalprice", 5).withColumnRenamed("o_totalprice_bin", "qbin")
    return alternative.binned(o, "o_totalprice", 4, "equal").withColumnRenamed("o_totalprice_bin", "wbin").drop("o_totalprice")


@query()
def principal_components(spark, sf):
    return rounded(alternative.principal_components(bars(spark, sf), ["o", "h", "l", "c", "v"], 2).select("secu", "d", "PC1", "PC2"))


@query()
def fourier(spark, sf):
    return rounded(alternative.fourier(bars(spark, sf), ["secu"], "d", "c"))
