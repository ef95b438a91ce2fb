"""Volume features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.panel import Panel, div, flag
from ..functions.rolling import rank_pct
from .price import Bar


def typical(b: Bar) -> Column:
    return (F.col(b.h) + F.col(b.l) + F.col(b.c)) / 3


def vwap(p: Panel, b: Bar, n: int, price: Column | None = None) -> Column:
    price = typical(b) if price is None else price
    return div(p.total(price * F.col(b.v), n), p.total(b.v, n))


def indicators(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (5, 20, 60)) -> DataFrame:
    """Volume mean, ratio to it, deviation and change over n rows, and the 20-row VWAP."""
    new = {"VWAP": vwap(p, b, 20)}
    for n in windows:
        new |= {f"Volume_MA_{n}": p.mean(b.v, n), f"Volume_Ratio_{n}": div(b.v, p.mean(b.v, n)), f"Volume_Std_{n}": p.std(b.v, n), f"Volume_Change_{n}": p.pct(b.v, n)}
    return df.withColumns(new)


def price_volume(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (5, 20)) -> DataFrame:
    """Correlation of return and volume, divergence of both from their means, close-weighted VWAP."""
    df = df.withColumn("__r", p.pct(b.c))
    new = {}
    for n in windows:
        w = vwap(p, b, n, F.col(b.c))
        new |= {
            f"PriceVolume_Corr_{n}": p.corr("__r", b.v, n),
            f"PriceVolume_Divergence_{n}": div(F.col(b.c) - p.mean(b.c, n), p.mean(b.c, n)) - div(F.col(b.v) - p.mean(b.v, n), p.mean(b.v, n)),
            f"VWAP_Momentum_{n}": div(F.col(b.c) - w, w),
        }
    return df.withColumns(new).drop("__r")


def mfi(df: DataFrame, p: Panel, b: Bar = Bar(), n: int = 14, name: str = "MFI") -> DataFrame:
    """Money flow index; the first row's flow counts as none. NULL without any flow."""
    df = df.withColumn("__t", typical(b))
    flow, before = F.col("__t") * F.col(b.v), p.lag("__t")
    df = df.withColumns({"__up": F.when(F.coalesce(F.col("__t") > before, F.lit(False)), flow).otherwise(0.0), "__down": F.when(F.coalesce(F.col("__t") < before, F.lit(False)), flow).otherwise(0.0)})
    up, down = p.total("__up", n), p.total("__down", n)
    return df.withColumn(name, div(100 * up, up + down)).drop("__t", "__up", "__down")


def patterns(df: DataFrame, p: Panel, b: Bar = Bar(), n: int = 20, year: int = 252) -> DataFrame:
    """z-score, spikes (z over 2), sign of the change over five rows, rank within a year."""
    df = df.withColumn("Volume_ZScore", p.zscore(b.v, n))
    trend = F.when(F.count(b.v).over(p.last_n(5)) == 5, F.signum(p.diff(b.v, 4)))
    return rank_pct(df.withColumns({"Volume_Spike": flag(F.col("Volume_ZScore") > 2), "Volume_Trend": trend}), p, {"Volume_Percentile": b.v}, year)


def momentum_rate(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (5, 10, 20)) -> DataFrame:
    return df.withColumns({f"Volume_Momentum_{n}": p.pct(b.v, n) for n in windows})


def ad_line(df: DataFrame, p: Panel, b: Bar = Bar()) -> DataFrame:
    """Running sum of the close's place in the range times volume; a range of zero counts as one."""
    span = F.when(F.col(b.h) == F.col(b.l), 1.0).otherwise(F.col(b.h) - F.col(b.l))
    flow = ((F.col(b.c) - F.col(b.l)) - (F.col(b.h) - F.col(b.c))) / span * F.col(b.v)
    return df.withColumn("AD_Line", F.sum(flow).over(p.so_far))


def vpt(df: DataFrame, p: Panel, b: Bar = Bar()) -> DataFrame:
    """Running sum of return times volume; NULL where the return is."""
    df = df.withColumn("__f", p.pct(b.c) * F.col(b.v))
    return df.withColumn("VPT", F.when(F.col("__f").isNotNull(), F.sum("__f").over(p.so_far))).drop("__f")


def absolute_volume(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (5, 20, 50, 200)) -> DataFrame:
    return df.withColumns({"Volume_Current": F.col(b.v)} | {f"Volume_MA_{n}": p.mean(b.v, n) for n in windows})


def volume_change(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Rate of change and, as momentum, difference."""
    return df.withColumns({f"Volume_Change_Rate_{n}": p.pct(b.v, n) for n in windows} | {f"Volume_Momentum_{n}": p.diff(b.v, n) for n in windows})


def divergence(df: DataFrame, p: Panel, b: Bar = Bar(), n: int = 20) -> DataFrame:
    """New extremes of price or volume over n rows that the other doesn't confirm."""
    ph, pl = F.col(b.c) == p.high(b.c, n), F.col(b.c) == p.low(b.c, n)
    vh, vl = F.col(b.v) == p.high(b.v, n), F.col(b.v) == p.low(b.v, n)
    return df.withColumns({"Price_High_Unconfirmed": flag(ph & ~vh), "Price_Low_Unconfirmed": flag(pl & ~vl), "Volume_High_Unconfirmed": flag(vh & ~ph), "Volume_Low_Unconfirmed": flag(vl & ~pl)})


def vwap_set(df: DataFrame, p: Panel, b: Bar = Bar(), windows: Sequence[int] = (15, 30, 60, 240)) -> DataFrame:
    return df.withColumns({f"VWAP_{n}": vwap(p, b, n) for n in windows})


def turnover_rate(df: DataFrame, float_shares, b: Bar = Bar()) -> DataFrame:
    """Volume over free float, a number or a column."""
    shares = F.col(float_shares) if isinstance(float_shares, str) else F.lit(float(float_shares))
    return df.withColumn("Turnover_Rate", div(b.v, shares))


def block_trades(df: DataFrame, p: Panel, b: Bar = Bar(), multiplier: float = 3.0, deviation: float = 0.02, n: int = 20) -> DataFrame:
    """Large volume, a close off the typical price, and volume over three deviations from its mean."""
    m, s, t = p.mean(b.v, n), p.std(b.v, n), typical(b)
    return df.withColumns({"Large_Volume": flag(F.col(b.v) > m * multiplier), "Price_Deviation": flag(div(F.abs(F.col(b.c) - t), t) > deviation), "Abnormal_Volume": flag(F.abs(F.col(b.v) - m) > 3 * s)})


def volume_features(df: DataFrame, p: Panel, b: Bar = Bar(), float_shares=None, vwap_windows: Sequence[int] = (15, 30, 60, 240), ma_windows: Sequence[int] = (5, 20, 50, 200), change_windows: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """The whole documented group."""
    df = vwap_set(volume_change(absolute_volume(df, p, b, ma_windows), p, b, change_windows), p, b, vwap_windows)
    df = block_trades(divergence(mfi(df, p, b), p, b), p, b)
    return df if float_shares is None else turnover_rate(df, float_shares, b)
