"""Price features: returns, momentum, volatility, trend, support and resistance.

Each function adds columns to a panel of bars. ``O H L C`` name the bar's columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.panel import Panel, div, ema, ln, root

YEAR = 252.0
FIB = (0.236, 0.382, 0.5, 0.618, 0.786)


@dataclass(frozen=True)
class Bar:
    """Column names of a bar."""

    o: str = "OpenPrice"
    h: str = "HighPrice"
    l: str = "LowPrice"  # noqa: E741
    c: str = "ClosePrice"
    v: str = "TurnoverVolume"


def resolve(df: DataFrame) -> Bar:
    """The bar's columns by the usual names: long, capitalised or lower case."""
    names = {"o": ("OpenPrice", "Open", "open"), "h": ("HighPrice", "High", "high"), "l": ("LowPrice", "Low", "low"), "c": ("ClosePrice", "Close", "close"), "v": ("TurnoverVolume", "Volume", "volume")}
    found = {k: next((n for n in options if n in df.columns), None) for k, options in names.items()}
    if found["c"] is None:
        raise ValueError("no close price among the columns")
    return Bar(**{k: v or getattr(Bar, k) for k, v in found.items()})


def returns(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (1, 5, 20, 60, 252)) -> DataFrame:
    """Return (gaps filled forward first), log return and cumulative return (gaps stay gaps) over n rows."""
    df = df.withColumn("__c", p.ffill(b.c))
    new = {}
    for n in windows:
        new |= {f"Return_{n}d": p.pct("__c", n), f"LogReturn_{n}d": ln(div(b.c, p.lag(b.c, n))), f"CumReturn_{n}d": p.pct(b.c, n)}
    return df.withColumns(new).drop("__c")


def momentum(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (5, 10, 20, 60)) -> DataFrame:
    new = {}
    for n in windows:
        new |= {f"Momentum_{n}d": p.diff(b.c, n), f"ROC_{n}d": p.pct(b.c, n) * 100, f"RelMomentum_{n}d": div(F.col(b.c) - p.mean(b.c, n), p.mean(b.c, n))}
    return df.withColumns(new)


def true_range(p: Panel, b: Bar):
    """The largest of the three ranges that are known."""
    before = p.lag(b.c)
    return F.greatest(F.col(b.h) - F.col(b.l), F.abs(F.col(b.h) - before), F.abs(F.col(b.l) - before))


def volatility(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (20, 60, 252)) -> DataFrame:
    """Historical, realized, Parkinson and Garman-Klass volatility (a row whose radicand is negative is unknown), and ATR."""
    gk = 0.5 * F.pow(ln(div(b.h, b.l)), 2) - (2 * math.log(2) - 1) * F.pow(ln(div(b.c, b.o)), 2)
    df = df.withColumns({"__r": ln(div(b.c, p.lag(b.c))), "__hl": F.pow(ln(div(b.h, b.l)), 2), "__gk": root(gk), "__tr": true_range(p, b)})
    new = {}
    for n in windows:
        new |= {
            f"HistVol_{n}d": p.std("__r", n) * math.sqrt(YEAR),
            f"RealizedVol_{n}d": F.sqrt(p.total(F.col("__r") * F.col("__r"), n) * YEAR / n),
            f"ParkinsonVol_{n}d": F.sqrt(p.total("__hl", n) * YEAR / (4 * n * math.log(2))),
            f"GKVol_{n}d": p.mean("__gk", n) * math.sqrt(YEAR),
            f"ATR_{n}d": p.mean("__tr", n),
        }
    return df.withColumns(new).drop("__r", "__hl", "__gk", "__tr")


def trend(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (20, 50, 200), band: int = 20, width: float = 2.0) -> DataFrame:
    """Moving averages, the close's place against them, and Bollinger bands (sample deviation)."""
    new = {}
    for n in windows:
        new |= {f"SMA_{n}": p.mean(b.c, n), f"PricePos_{n}": div(F.col(b.c) - p.mean(b.c, n), p.mean(b.c, n))}
    df = df.withColumns(new | {"__m": p.mean(b.c, band), "__s": p.std(b.c, band)})
    df = df.withColumns({"BB_Upper": F.col("__m") + width * F.col("__s"), "BB_Lower": F.col("__m") - width * F.col("__s")})
    span = F.col("BB_Upper") - F.col("BB_Lower")
    return df.withColumns({"BB_Width": div(span, "__m"), "BB_Position": div(F.col(b.c) - F.col("BB_Lower"), span)}).drop("__m", "__s")


def trend_ema(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (20, 50, 200)) -> DataFrame:
    return ema(df, p, {f"EMA_{n}": (b.c, n) for n in windows})


def support_resistance(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (20, 60, 252)) -> DataFrame:
    new = {}
    for n in windows:
        new |= {f"Support_{n}d": p.low(b.l, n), f"Resistance_{n}d": p.high(b.h, n)}
    df = df.withColumns(new)
    return df.withColumns({f"PricePosition_{n}d": div(F.col(b.c) - F.col(f"Support_{n}d"), F.col(f"Resistance_{n}d") - F.col(f"Support_{n}d")) for n in windows})


def fibonacci(df: DataFrame, p: Panel, b: Bar = Bar(), n: int = 20, levels: Sequence[float] = FIB) -> DataFrame:
    """Retracement levels as ``Fib_236`` and so on (no dots in names)."""
    hi, lo = p.high(b.h, n), p.low(b.l, n)
    return df.withColumns({f"Fib_{round(x * 1000)}": hi - x * (hi - lo) for x in levels})


def all_price(df: DataFrame, p: Panel, b: Bar = Bar()) -> DataFrame:
    for step in (returns, momentum, volatility, trend, support_resistance, fibonacci):
        df = step(df, p, b)
    return df


def momentum_factor(df: DataFrame, p: Panel, column: str = "adj_close", lookback: int = 21) -> DataFrame:
    """Return over ``lookback`` rows of an adjusted close."""
    return df.withColumn("Momentum", p.pct(column, lookback))


def cross_asset(df: DataFrame, other: DataFrame, p: Panel, on: Sequence[str], column: str, name: str, n: int = 20) -> DataFrame:
    """Spread, ratio and rolling correlation against one other asset's prices of the same time."""
    df = df.join(other.select(*on, F.col(column).alias("__other")), list(on), "left")
    return df.withColumns({f"Spread_vs_{name}": F.col(column) - F.col("__other"), f"Ratio_vs_{name}": div(column, "__other"), f"Corr_vs_{name}": p.corr(column, "__other", n)}).drop("__other")
