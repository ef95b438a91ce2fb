"""Order-book and micro-structure features from snapshots with columns Bid_Price1.., Bid_Size1.., Ask_Price1.., Ask_Size1.. ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.panel import Panel, div, flag


def _need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def imbalance(df: DataFrame) -> DataFrame:
    """Mid, spread, order-flow imbalance, pressure, ratio and depth at the first level."""
    _need(df, "Bid_Price1", "Bid_Size1", "Ask_Price1", "Ask_Size1")
    bp, bs, ap, az = (F.col(x) for x in ("Bid_Price1", "Bid_Size1", "Ask_Price1", "Ask_Size1"))
    mid, spread = (bp + ap) / 2, ap - bp
    return df.withColumns({"Mid_Price": mid, "Spread": spread, "Spread_Ratio": div(spread, mid), "OFI": div(bs - az, bs + az), "Price_Pressure": div(ap - mid, spread), "Bid_Ask_Ratio": div(bs, az), "Total_Depth": bs + az})


def book_imbalance(df: DataFrame, levels: int = 5) -> DataFrame:
    """Imbalance and pressure of each level that is there, their sum, and their mean weighted by 1 / level."""
    have = [k for k in range(1, levels + 1) if {f"Bid_Size{k}", f"Ask_Size{k}", f"Bid_Price{k}", f"Ask_Price{k}"} <= set(df.columns)]
    new: dict[str, Column] = {}
    for k in have:
        bs, az, bp, ap = (F.col(f"{s}{k}") for s in ("Bid_Size", "Ask_Size", "Bid_Price", "Ask_Price"))
        new |= {f"OFI_Level_{k}": div(bs - az, bs + az), f"Price_Pressure_Level_{k}": div(ap - (bp + ap) / 2, ap - bp)}
    if not have:
        return df
    df = df.withColumns(new)
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    known = [F.coalesce(F.col(f"OFI_Level_{k}"), F.lit(0.0)) for k in have]
    return df.withColumns({"Cumulative_OFI": total(known), "Weighted_OFI": total([x / k for x, k in zip(known, have, strict=True)]) / sum(1 / k for k in have)})


def microstructure(df: DataFrame, p: Panel, price: str = "Mid_Price", volume: str = "Volume", n: int = 20) -> DataFrame:
    """Impact, its volume-weighted mean, volatilities, Kyle's lambda and Amihud's illiquidity."""
    df = df.withColumn("Price_Impact", p.pct(price))
    a, v = F.abs(F.col("Price_Impact")), F.col(volume)
    return df.withColumns({
        "Volume_Weighted_Price_Impact": div(p.total(F.col("Price_Impact") * v, n), p.total(v, n)), "Price_Volatility": p.std("Price_Impact", n), "Volume_Volatility": p.std(v, n),
        "Kyle_Lambda": div(p.mean(a * v, n), p.mean(v * v, n)), "Amihud_Illiquidity": p.mean(div(a, v), n),
    })


def flow_metrics(df: DataFrame, p: Panel, volume: str = "Volume", n: int = 20) -> DataFrame:
    """Means, deviation, z-score and slope of the imbalance, and its correlation with volume."""
    df = p.numbered(df)
    df = df.withColumns({"OFI_MA": p.mean("OFI", n), "OFI_Std": p.std("OFI", n), "OFI_Trend": p.slope("OFI", n), "Volume_OFI_Corr": p.corr(volume, "OFI", n), "Bid_Flow_Ratio": div("Bid_Size1", F.col("Bid_Size1") + F.col("Ask_Size1")), "Ask_Flow_Ratio": div("Ask_Size1", F.col("Bid_Size1") + F.col("Ask_Size1"))})
    df = df.withColumn("OFI_ZScore", div(F.col("OFI") - F.col("OFI_MA"), "OFI_Std"))
    return df.withColumn("Large_Order_Indicator", flag(F.abs(F.col("OFI_ZScore")) > 2)).drop("__n")


def market_impact(df: DataFrame, p: Panel, price: str = "Mid_Price", volume: str = "Volume", n: int = 20) -> DataFrame:
    r = p.pct(price)
    df = df.withColumn("__r", r)
    v = F.col(volume)
    return df.withColumns({"Market_Price_Impact": F.col("__r"), "Temporary_Impact": F.col("OFI") * F.col("__r"), "Permanent_Impact": p.mean(F.col("__r") * v, n), "Impact_Coefficient": p.mean(div(F.abs(F.col("__r")), v), n), "Order_Flow_Impact": p.mean(F.col("OFI") * F.col("__r"), n), "Impact_Volatility": p.std("__r", n)}).drop("__r")


def liquidity(df: DataFrame, p: Panel, volume: str = "Volume", n: int = 20) -> DataFrame:
    bp, bs, ap, az = (F.col(x) for x in ("Bid_Price1", "Bid_Size1", "Ask_Price1", "Ask_Size1"))
    mid, spread, depth = (bp + ap) / 2, ap - bp, bs + az
    df = p.numbered(df).withColumns({
        "Bid_Ask_Spread": spread, "Effective_Spread": 2 * spread, "Quoted_Spread": spread, "Relative_Spread": div(spread, mid), "Liquidity_Ratio": div(volume, spread), "Market_Depth": depth,
        "Liquidity_Index": div(depth, spread), "Liquidity_Cost": div(spread, depth), "Liquidity_Pressure": div(az - bs, az + bs),
    })
    return df.withColumn("Liquidity_Trend", p.slope("Liquidity_Index", n)).drop("__n")


def all_orderbook(df: DataFrame, p: Panel, volume: str = "Volume", levels: int = 5, n: int = 20) -> DataFrame:
    """All of it that the columns allow."""
    df = book_imbalance(imbalance(df), levels)
    if volume in df.columns:
        for step in (microstructure, market_impact):
            df = step(df, p, volume=volume, n=n)
        df = liquidity(flow_metrics(df, p, volume, n), p, volume, n)
    return df


def summary(df: DataFrame, p: Panel, columns: tuple[str, ...] = ("OFI", "Spread", "Total_Depth")) -> DataFrame:
    """Now, mean, deviation, extremes and change over the series."""
    at = F.struct(*p.time)
    return df.groupBy(*p.by).agg(*[x for c in columns for x in (F.max_by(c, at).alias(f"{c}_current"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"), (F.max_by(c, at) - F.min_by(c, at)).alias(f"{c}_change"))])
