"""Technical indicators, candlestick patterns and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.panel import Panel, div, ema, flag
from .price import Bar, true_range


def rsi(df: DataFrame, p: Panel, b: Bar = Bar(), n: int = 14) -> DataFrame:
    """From simple means of gains and losses; the first difference counts as none. NULL where nothing moved."""
    change = F.coalesce(p.diff(b.c), F.lit(0.0))
    df = df.withColumns({"__g": F.greatest(change, F.lit(0.0)), "__l": F.greatest(-change, F.lit(0.0))})
    g, lo = p.mean("__g", n), p.mean("__l", n)
    return df.withColumn(f"RSI_{n}", div(100 * g, g + lo)).drop("__g", "__l")


def macd(df: DataFrame, p: Panel, b: Bar = Bar(), fast: int = 12, slow: int = 26, signal: int = 9, adjust: bool = False) -> DataFrame:
    """MACD, its signal line and histogram. ``adjust`` corrects the bias of the first values."""
    out = ema(df, p, {"__f": (b.c, fast), "__s": (b.c, slow), "MACD_Signal": (("__f", "__s"), signal)}, adjust)
    out = out.withColumn("MACD", F.col("__f") - F.col("__s")).drop("__f", "__s")
    return out.withColumn("MACD_Histogram", F.col("MACD") - F.col("MACD_Signal"))


def bollinger(df: DataFrame, p: Panel, b: Bar = Bar(), n: int = 20, width: float = 2.0) -> DataFrame:
    m, s = p.mean(b.c, n), p.std(b.c, n)
    df = df.withColumns({"BB_Middle": m, "BB_Upper": m + width * s, "BB_Lower": m - width * s})
    span = F.col("BB_Upper") - F.col("BB_Lower")
    return df.withColumns({"BB_Width": div(span, "BB_Middle"), "BB_Position": div(F.col(b.c) - F.col("BB_Lower"), span)})


def stochastic(df: DataFrame, p: Panel, b: Bar = Bar(), n: int = 14, smooth: int = 3) -> DataFrame:
    lo, hi = p.low(b.l, n), p.high(b.h, n)
    df = df.withColumn("Stoch_K", div(100 * (F.col(b.c) - lo), hi - lo))
    return df.withColumn("Stoch_D", p.mean("Stoch_K", smooth))


def williams_r(df: DataFrame, p: Panel, b: Bar = Bar(), n: int = 14) -> DataFrame:
    lo, hi = p.low(b.l, n), p.high(b.h, n)
    return df.withColumn("Williams_R", div(-100 * (hi - F.col(b.c)), hi - lo))


def atr(df: DataFrame, p: Panel, b: Bar = Bar(), n: int = 14) -> DataFrame:
    df = df.withColumn("__tr", true_range(p, b))
    return df.withColumn(f"ATR_{n}", p.mean("__tr", n)).drop("__tr")


def candlesticks(df: DataFrame, p: Panel, b: Bar = Bar(), hanging_on_equal: bool = False) -> DataFrame:
    """0/1 patterns. ``hanging_on_equal``: a hanging man may also close where it opened."""
    o, h, lo, c = (F.col(x) for x in (b.o, b.h, b.l, b.c))
    body = F.abs(c - o)
    below, above = F.least(o, c) - lo, h - F.greatest(o, c)
    shape = (below > 2 * body) & (above < body)
    po, pc = p.lag(b.o), p.lag(b.c)
    return df.withColumns({
        "Hammer": flag(shape & (c > o)), "Hanging_Man": flag(shape & ((c <= o) if hanging_on_equal else (c < o))), "Doji": flag(body < 0.1 * (h - lo)),
        "Bullish_Engulfing": flag((c > o) & (pc < po) & (o < pc) & (c > po)), "Bearish_Engulfing": flag((c < o) & (pc > po) & (o > pc) & (c < po)),
    })


def _starts(day: Column, unit: str) -> Column:
    return flag(F.trunc(day, unit) == day)


def _ends(day: Column, unit: str) -> Column:
    return flag(F.trunc(F.date_add(day, 1), unit) == F.date_add(day, 1))


def calendar(df: DataFrame, day: str = "TradingDay") -> DataFrame:
    """Day of week (Monday 0), month, quarter, day of year, ISO week, and first and last days of month, quarter, year."""
    d = F.col(day).cast("date")
    new = {"DayOfWeek": F.weekday(d), "Month": F.month(d), "Quarter": F.quarter(d), "DayOfYear": F.dayofyear(d), "WeekOfYear": F.weekofyear(d)}
    for name, unit in (("Month", "month"), ("Quarter", "quarter"), ("Year", "year")):
        new |= {f"Is{name}Start": _starts(d, unit), f"Is{name}End": _ends(d, unit)}
    return df.withColumns(new)


def seasonality(df: DataFrame, p: Panel, b: Bar = Bar(), day: str = "TradingDay", expanding: bool = False) -> DataFrame:
    """Mean return of the month and of the weekday over the whole series, or with ``expanding`` only up to the row before."""
    d = F.col(day).cast("date")
    df = df.withColumns({"__r": p.pct(b.c), "__m": F.month(d), "__d": F.weekday(d)})
    if expanding:
        over = lambda k: Window.partitionBy(*p.by, k).orderBy(*p.time).rowsBetween(Window.unboundedPreceding, -1)
    else:
        over = lambda k: Window.partitionBy(*p.by, k)
    return df.withColumns({"Monthly_Seasonality": F.avg("__r").over(over("__m")), "Weekly_Seasonality": F.avg("__r").over(over("__d"))}).drop("__r", "__m", "__d")


def all_technical(df: DataFrame, p: Panel, b: Bar = Bar(), day: str = "TradingDay") -> DataFrame:
    """Everything but the exponential means, which are folds of their own."""
    missing = [x for x in (b.o, b.h, b.l, b.c) if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for step in (rsi, bollinger, stochastic, williams_r, atr, candlesticks):
        df = step(df, p, b)
    return calendar(df, day)


def summary(df: DataFrame, p: Panel) -> DataFrame:
    """One row a series: RSI now and on average, extremes, MACD crosses, band breaks, pattern counts."""
    d = F.col("MACD") - F.col("MACD_Signal")
    df = df.withColumns({"__d": d, "__p": p.lag(d)})
    last = F.struct(*p.time)
    return df.groupBy(*p.by).agg(
        F.max_by("RSI_14", last).alias("rsi_current"), F.avg("RSI_14").alias("rsi_mean"), F.count_if(F.col("RSI_14") > 70).alias("overbought"), F.count_if(F.col("RSI_14") < 30).alias("oversold"),
        F.count_if((F.col("__d") > 0) & (F.col("__p") <= 0)).alias("golden_crosses"), F.count_if((F.col("__d") < 0) & (F.col("__p") >= 0)).alias("death_crosses"),
        F.count_if(F.col("BB_Position") > 1).alias("above_upper"), F.count_if(F.col("BB_Position") < 0).alias("below_lower"),
        *[F.sum(x).alias(x.lower()) for x in ("Hammer", "Hanging_Man", "Doji", "Bullish_Engulfing", "Bearish_Engulfing")],
    )
