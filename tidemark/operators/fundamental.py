"""Valuation, growth, industry and quality features of panels of fundamentals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.panel import Panel, div, flag
from ..functions.rolling import rank_pct


def valuation(df: DataFrame, p: Panel, column: str, windows: Sequence[int] = (20, 60), year: int = 252) -> DataFrame:
    """Means of a valuation ratio, its ratio to the first, and its rank within a year."""
    new = {f"{column}_MA{n}": p.mean(column, n) for n in windows}
    return rank_pct(df.withColumns(new | {f"{column}_Relative": div(column, p.mean(column, windows[0]))}), p, {f"{column}_Percentile": column}, year)


def valuation_score(df: DataFrame, p: Panel, columns: Sequence[str], n: int = 20) -> DataFrame:
    """Mean rank of the row's ratios among themselves, and its rolling mean."""
    held = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    rank = lambda x: (F.size(F.filter(held, lambda y: y < x)) + (F.size(F.filter(held, lambda y: y == x)) + 1) / 2) / F.size(held)
    total = F.aggregate(F.transform(held, rank), F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("Valuation_Score", F.when(F.size(held) > 0, total / F.size(held)))
    return df.withColumn("Valuation_Score_MA", p.mean("Valuation_Score", n))


def growth(df: DataFrame, p: Panel, column: str, year: int = 252, quarter: int = 63, windows: Sequence[int] = (20, 60)) -> DataFrame:
    """Change over a year and a quarter (in rows), means, z-score and coefficient of variation."""
    a, z = windows
    return df.withColumns({f"{column}_YoY": p.pct(column, year), f"{column}_QoQ": p.pct(column, quarter), f"{column}_MA{a}": p.mean(column, a), f"{column}_MA{z}": p.mean(column, z), f"{column}_Trend": p.zscore(column, a), f"{column}_Volatility": div(p.std(column, z), p.mean(column, z))})


def margins(df: DataFrame, p: Panel, profit: str = "NetProfit", revenue: str = "Revenue", assets: str = "TotalAssets", n: int = 20) -> DataFrame:
    df = df.withColumns({"Profit_Margin": div(profit, revenue), "Asset_Turnover": div(revenue, assets), "ROA": div(profit, assets)})
    return df.withColumns({f"{c}_MA": p.mean(c, n) for c in ("Profit_Margin", "Asset_Turnover", "ROA")})


def industry_relative(df: DataFrame, industry: Sequence[str], value: str, name: str) -> DataFrame:
    """Value less the mean, and over the mean, of its industry on the same date."""
    m = F.avg(value).over(Window.partitionBy(*industry))
    return df.withColumns({f"{name}_Excess": F.col(value) - m, f"{name}_Ratio": div(value, m), f"{name}_Share": div(value, F.sum(value).over(Window.partitionBy(*industry)))})


def quality(df: DataFrame, p: Panel, price: str = "ClosePrice", volume: str = "TurnoverVolume", n: int = 20) -> DataFrame:
    """Continuity (share of moves under 20 percent), positive price and volume, and their mean with a constant one."""
    df = df.withColumn("__ok", flag(F.abs(p.pct(price)) < 0.2).cast("double"))
    df = df.withColumns({"Data_Quality_Score": F.lit(1.0), "Price_Continuity": p.mean("__ok", n), "Price_Reasonable": flag(F.col(price) > 0).cast("double"), "Volume_Reasonable": flag(F.col(volume) >= 0).cast("double")}).drop("__ok")
    parts = [F.col(c) for c in ("Data_Quality_Score", "Price_Continuity", "Price_Reasonable", "Volume_Reasonable")]
    known = sum((x.isNotNull().cast("int") for x in parts[1:]), parts[0].isNotNull().cast("int"))
    return df.withColumn("Overall_Quality", sum((F.coalesce(x, F.lit(0.0)) for x in parts[1:]), F.coalesce(parts[0], F.lit(0.0))) / known)


def fundamental_features(df: DataFrame, p: Panel, ratios: Sequence[str] = (), figures: Sequence[str] = (), industry: Sequence[str] = ()) -> DataFrame:
    """All groups that the columns allow: valuation of ratios and their score, growth of figures, the first ratio against its industry."""
    for c in ratios:
        df = valuation(df, p, c)
    if ratios:
        df = valuation_score(df, p, ratios)
    for c in figures:
        df = growth(df, p, c)
    return industry_relative(df, industry, ratios[0], ratios[0]) if industry and ratios else df


def feature_names(df: DataFrame, made: DataFrame) -> list[str]:
    """The columns that ``made`` has besides those of ``df``."""
    return [c for c in made.columns if c not in df.columns]
