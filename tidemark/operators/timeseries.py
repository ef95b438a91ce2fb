"""Resampling, returns, volatility and time fields of panels; price adjustment; calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import by_day
from ..functions.panel import Panel, div, flag, ln
from .joins import asof
from .price import Bar

UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def period_end(day: Column, freq: str) -> Column:
    """The last day of the day's period; weeks end on Sunday."""
    if freq == "D":
        return day.cast("date")
    start = F.trunc(day, UNITS[freq])
    return {"W": F.date_add(start, 6), "M": F.last_day(day), "Q": F.last_day(F.add_months(start, 2)), "Y": F.last_day(F.add_months(start, 11))}[freq]


def resampled(df: DataFrame, freq: str = "M", how: str = "ohlc", by: Sequence[str] = ("SecuCode",), time: str = "TradingDay", b: Bar = Bar(), value: str = "TurnoverValue", fill_empty: bool = False) -> DataFrame:
    """Bars of longer periods, labelled by their last day. ``how``: ohlc, or last, mean or sum of every other number.

    ``fill_empty`` adds the periods between a series' first and last that have no rows: prices unknown, sums zero.
    """
    day = F.col(time).cast("date")
    group = df.groupBy(*by, period_end(day, freq).alias(time))
    at = F.struct(F.col(time))
    if how == "ohlc":
        aggs = [F.min_by(b.o, at).alias(b.o), F.max(b.h).alias(b.h), F.min(b.l).alias(b.l), F.max_by(b.c, at).alias(b.c), F.sum(b.v).alias(b.v)] + ([F.sum(value).alias(value)] if value in df.columns else [])
    else:
        numbers = [f.name for f in df.schema.fields if f.name not in (*by, time) and f.dataType.typeName() in ("double", "float", "long", "integer", "decimal", "short", "byte")]
        f = {"last": lambda c: F.max_by(c, at), "mean": F.avg, "sum": F.sum}[how]
        aggs = [f(c).alias(c) for c in numbers]
    out = group.agg(*aggs)
    if not fill_empty:
        return out
    step = {"D": "interval 1 day", "W": "interval 7 day", "M": "interval 1 month", "Q": "interval 3 month", "Y": "interval 1 year"}[freq]
    span = out.groupBy(*by).agg(F.trunc(F.min(time), "month").alias("a") if freq in "MQY" else F.min(time).alias("a"), F.max(time).alias("z"))
    grid = span.select(*by, F.explode(F.sequence("a", "z", F.expr(step))).alias("__d")).select(*by, period_end(F.col("__d"), freq).alias(time)).distinct()
    out = grid.join(out, [*by, time], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in (b.v, value) if c in out.columns}) if how in ("ohlc", "sum") else out


def rolling(df: DataFrame, p: Panel, columns: Sequence[str], n: int = 20, least: int | None = None, centre: bool = False) -> DataFrame:
    """Rolling mean and deviation of every column, trailing or centred."""
    w = p.w.rowsBetween(-(n // 2), (n - 1) // 2) if centre else p.last_n(n)
    ok = lambda c: F.count(c).over(w) >= (n if least is None else least)
    return df.withColumns({f"{c}_{k}": F.when(ok(c), f(c).over(w)) for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_samp))})


def weighted_mean(df: DataFrame, p: Panel, column: str, weights: Sequence[float], name: str) -> DataFrame:
    """Rolling mean under a window of weights, oldest first."""
    n = len(weights)
    terms = [p.lag(column, n - 1 - i) * w if i < n - 1 else F.col(column) * w for i, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(name, total / sum(weights))


def simple_returns(df: DataFrame, p: Panel, column: str = "ClosePrice", how: str = "simple", name: str = "Return") -> DataFrame:
    return df.withColumn(name, p.pct(column) if how == "simple" else ln(div(column, p.lag(column))))


def rolling_volatility(df: DataFrame, p: Panel, b: Bar = Bar(), n: int = 20, how: str = "std", name: str = "Volatility") -> DataFrame:
    """Annualized: deviation of simple returns, Parkinson, or Garman-Klass (mean first, then the root)."""
    import math

    if how == "std":
        df = df.withColumn("__x", p.pct(b.c))
        made = p.std("__x", n) * math.sqrt(252)
    elif how == "parkinson":
        df = df.withColumn("__x", F.pow(ln(div(b.h, b.l)), 2) / (4 * math.log(2)))
        made = F.sqrt(p.mean("__x", n) * 252)
    elif how == "garman_klass":
        df = df.withColumn("__x", 0.5 * F.pow(ln(div(b.h, b.l)), 2) - (2 * math.log(2) - 1) * F.pow(ln(div(b.c, b.o)), 2))
        m = p.mean("__x", n)
        made = F.when(m >= 0, F.sqrt(m * 252))
    else:
        raise ValueError(f"unknown volatility {how}")
    return df.withColumn(name, made).drop("__x")


def time_fields(df: DataFrame, time: str = "TradingDay") -> DataFrame:
    d = F.col(time).cast("date")
    new = {"Year": F.year(d), "Month": F.month(d), "Day": F.dayofmonth(d), "DayOfWeek": F.weekday(d), "Quarter": F.quarter(d), "DayOfYear": F.dayofyear(d)}
    for name, unit in (("Month", "month"), ("Quarter", "quarter")):
        new |= {f"Is{name}Start": flag(F.trunc(d, unit) == d), f"Is{name}End": flag(F.trunc(F.date_add(d, 1), unit) == F.date_add(d, 1))}
    return df.withColumns(new)


def traded(df: DataFrame, volume: str = "TurnoverVolume", price: str = "ClosePrice", least_volume: float | None = None, least_price: float | None = None, most_price: float | None = None) -> DataFrame:
    """Rows within the bounds that are given."""
    for c, op in ((least_volume, F.col(volume) >= least_volume), (least_price, F.col(price) >= least_price), (most_price, F.col(price) <= most_price)):
        df = df if c is None else df.where(op)
    return df


# adjustment


def with_factor(df: DataFrame, factors: DataFrame, by: Sequence[str] = ("InnerCode",), time: str = "TradingDay", since: str = "ExDiviDate", factor: str = "RatioAdjustingFactor") -> DataFrame:
    """The adjusting factor in force on each day; 1 before the first."""
    return asof(df, factors, by, time, since, [factor], {factor: 1.0})


def adjusted(df: DataFrame, columns: Sequence[str], factor: str = "RatioAdjustingFactor", how: str = "forward") -> DataFrame:
    """``{column}_Adj``: times the factor (forward), over it (backward), or as it is (none); no factor counts as 1."""
    f = F.coalesce(F.col(factor), F.lit(1.0))
    make = {"forward": lambda c: F.col(c) * f, "backward": lambda c: div(c, f), "none": F.col}[how]
    return df.withColumns({f"{c}_Adj": make(c) for c in columns})


def factor_checks(df: DataFrame, factor: str = "RatioAdjustingFactor") -> DataFrame:
    """One row: how many factors are null, zero, negative, tiny, huge or normal, and their range."""
    f = F.col(factor)
    return df.agg(F.count("*").alias("total"), F.count_if(f.isNull()).alias("nulls"), F.count_if(f == 0).alias("zeros"), F.count_if(f < 0).alias("negatives"), F.count_if((f > 0) & (f < 0.001)).alias("tiny"), F.count_if(f > 1000).alias("huge"), F.count_if((f >= 0.001) & (f <= 1000)).alias("normal"), F.min(f).alias("least"), F.max(f).alias("most"), F.avg(f).alias("mean"), F.median(f).alias("median"))


# calendar


def trading_days(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """(day) Monday to Friday from start to end, without the holidays' days."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)) AS day").where(F.weekday("day") < 5)
    return days if holidays is None else days.join(holidays.select("day"), "day", "left_anti")


def neighbours(df: DataFrame, calendar: DataFrame, time: str, day: str = "day") -> DataFrame:
    """Whether the date trades, and the trading days before, after, and on or before it."""
    named = {"at": "as_trading_day", "before": "previous_trading_day", "after": "next_trading_day"}
    return by_day(df, time, calendar, day, list(named)).withColumnsRenamed(named).withColumn("is_trading_day", flag(F.col("as_trading_day") == F.col(time).cast("date")))


def rolling_spans(calendar: DataFrame, size: int, step: int, day: str = "day") -> DataFrame:
    """(start, end) of windows of ``size`` trading days, one every ``step``."""
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    return calendar.select(F.col(day).alias("start"), F.lead(day, size - 1).over(w).alias("end"), F.row_number().over(w).alias("__n")).where(f"end is not null and (__n - 1) % {step} = 0").drop("__n")


def period_bounds(as_of: Column, period: str) -> Column:
    """Where a period that ends at ``as_of`` begins: 1d, 1w, 1m, 3m, 6m or 1y before."""
    return {"1d": F.date_sub(as_of, 1), "1w": F.date_sub(as_of, 7), "1m": F.add_months(as_of, -1), "3m": F.add_months(as_of, -3), "6m": F.add_months(as_of, -6), "1y": F.add_months(as_of, -12)}[period]


def trading_period(df: DataFrame, start: str, period: str, calendar: DataFrame, day: str = "day") -> DataFrame:
    """Adds ``period_start`` and ``period_end``: the period (1d, 1w, 1m, 3m, 6m, 1y) that begins at ``start``, either end rolled back to a trading day; NULL before the first."""
    months = {"1m": 1, "3m": 3, "6m": 6, "1y": 12}
    if period not in {"1d", "1w", *months}:
        raise ValueError(f"unknown period {period}")
    d = F.col(start).cast("date")
    end = F.add_months(d, months[period]) if period in months else F.date_add(d, 7 if period == "1w" else 0)
    for name, column in (("period_start", d), ("period_end", end)):
        df = by_day(df.withColumn("__end", column), "__end", calendar, day, ["at"]).withColumnRenamed("at", name).drop("__end")
    return df


def fiscal(df: DataFrame, time: str, first_month: int = 4) -> DataFrame:
    """Fiscal year and quarter of years that begin in ``first_month``, and whether the day ends a month, quarter or year."""
    d = F.col(time).cast("date")
    moved = F.add_months(d, -(first_month - 1))
    nxt = F.date_add(d, 1)
    return df.withColumns({"fiscal_year": F.year(moved), "fiscal_quarter": F.quarter(moved), "is_month_end": flag(F.trunc(nxt, "month") == nxt), "is_quarter_end": flag(F.trunc(nxt, "quarter") == nxt), "is_year_end": flag(F.trunc(nxt, "year") == nxt)})
