"""Relational queries over the driver's tables in the roles of warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational
from .base import BARS, MONTH_BARS, NUDGE, W, bars, month_bars, query, read, rounded

QUOTES = f"""WITH {MONTH_BARS}, quotes AS (SELECT secu AS "InnerCode", d AS "TradingDay", c AS "ClosePrice", v AS "TurnoverVolume", amt AS "TurnoverValue" FROM b),
limits AS (SELECT "InnerCode", "TradingDay", round("ClosePrice" * 1.1, 2) AS "PriceCeiling", round("ClosePrice" * 0.9, 2) AS "PriceFloor" FROM quotes WHERE month("TradingDay") <> 2),
perf AS (SELECT "InnerCode", "TradingDay", CASE WHEN month("TradingDay") = 3 THEN 1 WHEN month("TradingDay") = 4 THEN NULL ELSE 0 END AS "Ifsuspend" FROM quotes WHERE month("TradingDay") <> 5),
secu AS (SELECT s_suppkey AS "InnerCode", s_name AS "SecuCode", CASE WHEN s_nationkey % 2 = 0 THEN 83 ELSE 90 END AS "SecuMarket", 1 AS "SecuCategory", CASE WHEN s_suppkey % 7 = 0 THEN 5 ELSE 1 END AS "ListedState" FROM supplier)"""


def warehouse(spark, sf):
    q = month_bars(spark, sf).select(F.col("secu").alias("InnerCode"), F.col("d").alias("TradingDay"), F.col("c").alias("ClosePrice"), F.col("v").alias("TurnoverVolume"), F.col("amt").alias("TurnoverValue"))
    m = F.month("TradingDay")
    limits = q.where(m != 2).select("InnerCode", "TradingDay", F.round(F.col("ClosePrice") * 1.1 * NUDGE, 2).alias("PriceCeiling"), F.round(F.col("ClosePrice") * 0.9 * NUDGE, 2).alias("PriceFloor"))
    perf = q.where(m != 5).select("InnerCode", "TradingDay", F.when(m == 3, 1).when(m == 4, None).otherwise(0).alias("Ifsuspend"))
    secu = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("InnerCode"), F.col("s_name").alias("SecuCode"), F.when(F.col("s_nationkey") % 2 == 0, 83).otherwise(90).alias("SecuMarket"), F.lit(1).alias("SecuCategory"), F.when(F.col("s_suppkey") % 7 == 0, 5).otherwise(1).alias("ListedState"))
    return q, limits, perf, secu


@query(QUOTES + """ SELECT q."InnerCode", q."TradingDay", round("ClosePrice", 6) + 0.0 AS "ClosePrice", round("TurnoverVolume", 6) + 0.0 AS "TurnoverVolume", round("TurnoverValue", 2) + 0.0 AS "TurnoverValue", round("PriceCeiling", 2) + 0.0 AS "PriceCeiling", round("PriceFloor", 2) + 0.0 AS "PriceFloor", p."Ifsuspend", s."SecuCode", s."SecuMarket"
FROM quotes q LEFT JOIN limits l ON l."InnerCode" = q."InnerCode" AND l."TradingDay" = q."TradingDay" LEFT JOIN perf p ON p."InnerCode" = q."InnerCode" AND p."TradingDay" = q."TradingDay" LEFT JOIN secu s ON s."InnerCode" = q."InnerCode"
WHERE s."SecuCategory" = 1 AND s."SecuMarket" IN (83, 90) AND s."ListedState" = 1 AND q."TradingDay" BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND (p."Ifsuspend" IS NULL OR p."Ifsuspend" = 0)""")
def quote_history(spark, sf):
    return rounded(relational.quote_history(*warehouse(spark, sf), "1996-01-01", "1999-12-31"), TurnoverValue=2, PriceCeiling=2, PriceFloor=2)


@query(QUOTES + """ SELECT q."InnerCode", q."TradingDay", round("ClosePrice", 6) + 0.0 AS "ClosePrice", s."SecuCode" FROM quotes q JOIN secu s ON s."InnerCode" = q."InnerCode" WHERE s."InnerCode" % 10 = 3 AND q."TradingDay" BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def quotes_by_code(spark, sf):
    q, _, _, secu = warehouse(spark, sf)
    codes = secu.where("InnerCode % 10 = 3").select("SecuCode")
    return rounded(relational.quotes_by_code(q, secu, codes, "1996-01-01", "1999-12-31").select("InnerCode", "TradingDay", "ClosePrice", "SecuCode"))


@query(QUOTES + ' SELECT "InnerCode", "SecuCode", "SecuMarket" FROM secu WHERE "ListedState" = 1')
def stock_list(spark, sf):
    return relational.stock_list(warehouse(spark, sf)[3]).select("InnerCode", "SecuCode", "SecuMarket")


@query(QUOTES + """ SELECT DISTINCT "TradingDay" FROM quotes WHERE "TradingDay" BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def trading_dates(spark, sf):
    return relational.trading_dates(warehouse(spark, sf)[0], "1996-01-01", "1999-12-31")


@query("SELECT n_regionkey AS market, count(DISTINCT l_suppkey) AS stock_count, round(sum(l_quantity), 4) + 0.0 AS total_volume, round(sum(l_extendedprice), 2) + 0.0 AS total_value, round(avg(l_extendedprice / l_quantity), 6) + 0.0 AS avg_close FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def market_summary(spark, sf):
    li = read(spark, sf, "lineitem").join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    li = li.select(F.col("n_regionkey").alias("market"), "l_suppkey", "l_quantity", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    return rounded(relational.market_summary(li, "market", "l_suppkey", "l_quantity", "l_extendedprice", "px"), total_volume=4, total_value=2)


SUSPEND = f"""WITH {BARS}, g AS (SELECT secu, d, lead(d) OVER {W} AS nxt FROM b), susp AS (SELECT secu AS "InnerCode", 'S' || secu AS "SecuCode", d + 1 AS "SuspendDate", CASE WHEN (nxt - d) % 3 = 0 THEN NULL ELSE nxt END AS "ResumptionDate", CAST((nxt - d) % 4 * 10 AS INTEGER) AS "InfoSource", CASE WHEN (nxt - d) % 2 = 0 THEN 'Major Event' ELSE 'shareholder meeting' END AS "SuspendReason" FROM g WHERE nxt - d > 1)"""
SOURCES = {10: "exchange", 20: "company"}


def suspensions_of(spark, sf):
    from pyspark.sql.window import Window

    b = bars(spark, sf).select("secu", "d", F.lead("d").over(Window.partitionBy("secu").orderBy("d")).alias("nxt"))
    n = F.datediff("nxt", "d")
    return b.where(n > 1).select(F.col("secu").alias("InnerCode"), F.concat(F.lit("S"), F.col("secu").cast("string")).alias("SecuCode"), F.date_add("d", 1).alias("SuspendDate"), F.when(n % 3 != 0, F.col("nxt")).alias("ResumptionDate"), (n % 4 * 10).cast("int").alias("InfoSource"), F.when(n % 2 == 0, "Major Event").otherwise("shareholder meeting").alias("SuspendReason"))


@query(SUSPEND + """ SELECT "InnerCode", "SuspendDate", "ResumptionDate", CAST("ResumptionDate" IS NULL OR "ResumptionDate" > DATE '1999-01-01' AS INTEGER) AS is_suspended, CAST(coalesce("ResumptionDate", DATE '1999-01-01') - "SuspendDate" AS INTEGER) AS suspend_days, CASE "InfoSource" WHEN 10 THEN 'exchange' WHEN 20 THEN 'company' ELSE 'unknown(' || "InfoSource" || ')' END AS source FROM susp""")
def suspension_fields(spark, sf):
    df = relational.suspension_fields(suspensions_of(spark, sf), F.lit("1999-01-01").cast("date"))
    return df.select("InnerCode", "SuspendDate", "ResumptionDate", "is_suspended", "suspend_days", relational.decoded("InfoSource", SOURCES).alias("source"))


@query(SUSPEND + """ SELECT "InnerCode", "SuspendDate", "ResumptionDate", "SuspendReason" FROM susp WHERE "SuspendDate" BETWEEN DATE '1996-01-01' AND DATE '2001-12-31' AND lower("SuspendReason") LIKE '%major%' AND ("ResumptionDate" IS NULL OR "ResumptionDate" > DATE '1997-06-30')""")
def suspension_search(spark, sf):
    df = relational.suspensions(suspensions_of(spark, sf), None, "1996-01-01", "2001-12-31", "MAJOR", F.lit("1997-06-30").cast("date"))
    return df.select("InnerCode", "SuspendDate", "ResumptionDate", "SuspendReason")


@query(SUSPEND + """ SELECT "InfoSource", count(*) AS n, count(DISTINCT "InnerCode") AS stocks, round(avg("ResumptionDate" - "SuspendDate"), 6) + 0.0 AS avg_days FROM susp GROUP BY 1""")
def suspension_by_source(spark, sf):
    return rounded(relational.suspension_stats(suspensions_of(spark, sf), "InfoSource"))


@query(SUSPEND + """ SELECT "SuspendReason", count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM susp GROUP BY 1""")
def suspension_reasons(spark, sf):
    return rounded(relational.shares(suspensions_of(spark, sf), "SuspendReason"))


@query(SUSPEND + """, m AS (SELECT date_trunc('month', "SuspendDate") AS mon, count(*) AS n FROM susp GROUP BY 1), o AS (SELECT mon, "SuspendReason" AS r, count(*) AS c, row_number() OVER (PARTITION BY mon ORDER BY count(*) DESC, "SuspendReason") AS k FROM (SELECT date_trunc('month', "SuspendDate") AS mon, "SuspendReason" FROM susp) GROUP BY 1, 2) SELECT CAST(m.mon AS DATE) AS month, m.n, o.r AS commonest FROM m JOIN o ON o.mon = m.mon AND o.k = 1""")
def suspension_months(spark, sf):
    s = suspensions_of(spark, sf).select(F.trunc("SuspendDate", "month").alias("month"), "SuspendReason")
    each = s.groupBy("month", "SuspendReason").agg(F.count("*").alias("c"))
    return each.groupBy("month").agg(F.sum("c").alias("n"), F.min_by("SuspendReason", F.struct(-F.col("c"), "SuspendReason")).alias("commonest"))


@query(SUSPEND + """, new AS (SELECT "InnerCode", "SecuCode", "SuspendDate", CAST("SuspendDate" + 3 AS DATE) AS "ResumptionDate", 99 AS "InfoSource", "SuspendReason" FROM susp WHERE year("SuspendDate") = 1997), u AS (SELECT *, row_number() OVER (PARTITION BY "InnerCode", "SuspendDate" ORDER BY "InfoSource" DESC) AS k FROM (SELECT * FROM susp UNION ALL SELECT * FROM new)) SELECT "InnerCode", "SuspendDate", "ResumptionDate", "InfoSource" FROM u WHERE k = 1""")
def suspension_upsert(spark, sf):
    old = suspensions_of(spark, sf)
    new = old.where("year(SuspendDate) = 1997").withColumns({"ResumptionDate": F.date_add("SuspendDate", 3), "InfoSource": F.lit(99)})
    return relational.upserted(old, new, ["InnerCode", "SuspendDate"], "InfoSource").select("InnerCode", "SuspendDate", "ResumptionDate", "InfoSource")


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_k_per_group(spark, sf):
    from pyspark.sql.window import Window

    o = read(spark, sf, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("k <= 3")
    return rounded(o.select("o_custkey", "o_orderkey", "o_totalprice"), 2)


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL")
def monthly_counts(spark, sf):
    return read(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")).agg(F.count("*").alias("n"))
