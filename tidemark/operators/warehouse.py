"""Cookbook queries over warehouse tables. Frames here are n preceding rows and the current one, partial frames allowed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.panel import Panel, div, ln


def frame(p: Panel, n: int):
    return p.w.rowsBetween(-n, 0)


def over(p: Panel, agg, x, n: int) -> Column:
    return agg(x).over(frame(p, n))


def joined_quotes(quotes: DataFrame, technical: DataFrame, flow: DataFrame, keys: Sequence[str], close: str, volume: str) -> DataFrame:
    """Quotes with indicators and money flow, traded rows only."""
    q = quotes.where((F.col(close) > 0) & (F.col(volume) > 0))
    return q.join(technical, list(keys), "left").join(flow, list(keys), "left")


def volatility_block(df: DataFrame, p: Panel, h: str, low: str, c: str) -> DataFrame:
    """Population deviations of the close over 20 and 60 rows, of the log return, and the mean range of 14."""
    df = df.withColumn("__r", ln(div(c, p.lag(c))))
    tr = F.greatest(F.col(h) - F.col(low), F.abs(F.col(h) - p.lag(c)), F.abs(F.col(low) - p.lag(c)))
    df = df.withColumn("__t", tr)
    return df.withColumns({"vol_20": over(p, F.stddev_pop, c, 19), "vol_60": over(p, F.stddev_pop, c, 59), "ret_vol_20": over(p, F.stddev_pop, "__r", 19), "atr_14": over(p, F.avg, "__t", 13)}).drop("__r", "__t")


def trend_block(df: DataFrame, p: Panel, h: str, low: str, c: str) -> DataFrame:
    hi, lo = over(p, F.max, h, 59), over(p, F.min, low, 59)
    return df.withColumns({"ma5": over(p, F.avg, c, 4), "ma20": over(p, F.avg, c, 19), "ma60": over(p, F.avg, c, 59), "position_60": div(F.col(c) - lo, hi - lo), "momentum_5": div(c, p.lag(c, 5)) - 1, "momentum_20": div(c, p.lag(c, 20)) - 1})


def sector_ranks(df: DataFrame, day: str, sector: str, value: str) -> DataFrame:
    """Rank and percent rank within the sector on the date, and the value over the sector's mean."""
    w = Window.partitionBy(sector, day)
    return df.withColumns({"sector_rank": F.rank().over(w.orderBy(F.desc(value))), "sector_pct": F.percent_rank().over(w.orderBy(value)), "relative": div(value, F.avg(value).over(w))})


def bond_block(df: DataFrame, p: Panel, price: str, stock: str, convert: str) -> DataFrame:
    """Conversion value and premium, an option-value proxy, and the price over its mean of 21."""
    value = div(F.lit(100.0) * F.col(stock), convert)
    df = df.withColumns({"conversion_value": value, "premium": (div(price, value) - 1) * 100})
    return df.withColumns({"option_proxy": math.sqrt(2 * math.pi) * F.abs("premium") / 100, "price_to_ma": div(price, over(p, F.avg, price, 20))})


def margin_block(df: DataFrame, p: Panel, balance: str, short: str) -> DataFrame:
    """Ratio of the balances, their change, the balance over its mean of 21, and its percent rank on the date."""
    day = Window.partitionBy(*p.time)
    return df.withColumns({"margin_ratio": F.when(F.col(short) > 0, div(balance, short)), "margin_change": p.diff(balance), "margin_trend": div(balance, over(p, F.avg, balance, 20)), "margin_pct": F.percent_rank().over(day.orderBy(balance))})


def with_block_trades(df: DataFrame, trades: DataFrame, keys: Sequence[str], value: str, volume: str) -> DataFrame:
    """Block trades summed per key and date before the join."""
    per = trades.groupBy(*keys).agg(F.sum(value).alias("block_value"), F.sum(volume).alias("block_volume"), F.count("*").alias("block_count"))
    return df.join(per, list(keys), "left")


def alpha_block(df: DataFrame, p: Panel, price: str, index: str) -> DataFrame:
    """Excess of the return over the index's, 5 and 20 rows."""
    return df.withColumns({f"alpha_{n}": div(price, p.lag(price, n)) - div(index, p.lag(index, n)) for n in (5, 20)})


def rotation_block(df: DataFrame, p: Panel, price: str) -> DataFrame:
    """Momentum, strength against the date's mean, and two daily ranks."""
    day = Window.partitionBy(*p.time)
    df = df.withColumns({"momentum": div(price, p.lag(price, 20)) - 1, "__d": div(price, p.lag(price)) - 1})
    return df.withColumns({"strength": F.col("momentum") - F.avg("momentum").over(day), "momentum_rank": F.rank().over(day.orderBy(F.desc_nulls_last("momentum"))), "day_rank": F.rank().over(day.orderBy(F.desc_nulls_last("__d")))}).drop("__d")


def wide_table(base: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str], p: Panel, change: str, leads: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """Left joins on the keys, and the change of the row n later as target (of that day, not cumulative)."""
    for part in parts:
        base = base.join(part, list(keys), "left")
    return base.withColumns({f"Future_Return_{n}D": p.lead(change, n) for n in leads})


def table_quality(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.countDistinct(key).alias("distinct_keys"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in columns])


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, mean, std, min, max, outliers): population deviation; outliers beyond three of it."""
    long = df.unpivot([], list(columns), "feature", "x").where("x IS NOT NULL")
    s = long.groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = long.join(F.broadcast(s.select("feature", "mean", "std")), "feature").groupBy("feature").agg(F.count_if(F.abs(F.col("x") - F.col("mean")) > 3 * F.col("std")).alias("outliers"))
    return s.join(out, "feature")


def ranked_features(summary: DataFrame, least: float = 0.1) -> DataFrame:
    """Features by the size of their ratio, those over ``least``."""
    return summary.where(F.abs("icir") > least).withColumn("importance_rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("icir")))))


def financials(filings: DataFrame, industries: DataFrame, multiples: DataFrame, forecasts: DataFrame, code: str, industry: str, published: str, period: str, as_of: str) -> DataFrame:
    """Filings of one period with their industry, its multiples on the day of publication and the forecast of the period."""
    f = filings.where((F.col(period) == F.lit(as_of).cast("date")) & F.col(published).isNotNull()).join(industries, code)
    return f.join(multiples, [industry, published], "left").join(forecasts, [code, period], "left")
