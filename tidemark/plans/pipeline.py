"""Feature pipeline over panels: prepare, build, finish, report. Steps are named, so a run can pick some."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.panel import Panel
from ..operators import clean, price, quality, research, technical, timeseries, volume
from ..operators.price import Bar

Step = Callable[[DataFrame, Panel, Bar], DataFrame]
#: Groups of features by name, in the order in which they are built.
GROUPS: dict[str, tuple[Step, ...]] = {
    "price": (price.returns, price.momentum, price.volatility, price.trend, price.support_resistance, price.fibonacci),
    "volume": (volume.indicators, volume.price_volume, volume.mfi, volume.patterns),
    "technical": (technical.rsi, technical.stochastic, technical.williams_r, technical.candlesticks),
}
#: Named back-test periods and parameter sets.
PERIODS = {"full": ("2015-01-01", "2024-12-31"), "recent": ("2022-01-01", "2024-12-31"), "year": ("2024-01-01", "2024-12-31"), "crash": ("2015-06-01", "2016-02-29"), "recovery": ("2016-03-01", "2018-01-31"), "pandemic": ("2020-01-01", "2021-12-31"), "calm": ("2017-01-01", "2017-12-31")}
PARAMETERS = {"conservative": {"limit": 0.7, "risk": 0.5, "most": 0.5}, "moderate": {"limit": 0.6, "risk": 1.0, "most": 1.0}, "aggressive": {"limit": 0.5, "risk": 1.5, "most": 1.5}}


def features(df: DataFrame, p: Panel, groups: Sequence[str] = ("price", "volume", "technical"), b: Bar | None = None, day: str | None = None) -> DataFrame:
    """All groups on one window layout: one exchange and one sort by series, whatever the number of features."""
    b = b or price.resolve(df)
    unknown = [g for g in groups if g not in GROUPS]
    if unknown:
        raise ValueError(f"unknown feature groups: {', '.join(unknown)}")
    for g in groups:
        for step in GROUPS[g]:
            df = step(df, p, b)
    return technical.calendar(df, day) if day and "technical" in groups else df


@dataclass
class FeaturePipeline:
    """Prepare the bars, build the groups, finish the features."""

    panel: Panel
    groups: Sequence[str] = ("price", "volume", "technical")
    scale: bool = False
    keep: Sequence[str] = field(default_factory=tuple)

    def prepare(self, df: DataFrame) -> DataFrame:
        b = price.resolve(df)
        return clean.prepared(df, self.panel, b.o, b.h, b.l, b.c, b.v)

    def build(self, df: DataFrame) -> DataFrame:
        return features(df, self.panel, self.groups, day=self.panel.time[0])

    def finish(self, df: DataFrame, made: Sequence[str]) -> DataFrame:
        return clean.finished(df, made, self.scale)

    def run(self, df: DataFrame) -> DataFrame:
        before = set(df.columns)
        out = self.build(self.prepare(df))
        return self.finish(out, [c for c in clean.numeric(out) if c not in before and c not in self.keep])

    def warnings(self, df: DataFrame) -> DataFrame:
        """Jumps that may come from later knowledge."""
        b = price.resolve(df)
        return quality.lookahead(df, self.panel, [b.c, b.v])


def report(df: DataFrame, p: Panel) -> DataFrame:
    """One row: rows, series, range of time, share of missing values."""
    n = len(df.columns)
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.countDistinct(*p.by).alias("series"), F.min(p.time[0]).alias("first"), F.max(p.time[0]).alias("last"), (missing / (F.count("*") * n)).alias("missing_share"))


def feature_report(df: DataFrame, names: Sequence[str], target: str | None = None) -> DataFrame:
    """Statistics of each feature, outliers among them, and the strength of its correlation with the target."""
    out = quality.described(df, names).join(quality.consistency(df, names), "column_name")
    if target is None:
        return out
    pairs = research.correlations(df.select(*names, target), [*names, target]).where(F.col("b") == target)
    strength = F.when(F.abs("corr") >= 0.7, "strong").when(F.abs("corr") >= 0.3, "moderate").otherwise("weak")
    return out.join(pairs.select(F.col("a").alias("column_name"), "corr", strength.alias("strength")), "column_name", "left")


def daily(quotes: DataFrame, factors: DataFrame, p: Panel, by: Sequence[str], time: str, groups: Sequence[str] = ("price", "volume", "technical")) -> DataFrame:
    """Adjusted prices and all features of a quote table."""
    b = price.resolve(quotes)
    df = timeseries.with_factor(quotes, factors, by, time)
    df = timeseries.adjusted(df, [b.o, b.h, b.l, b.c])
    return features(df, p, groups, day=time)


def backtested(df: DataFrame, p: Panel, prediction: str, realised: str, period: str = "full", parameters: str = "moderate") -> DataFrame:
    """Signals of a named period under a named parameter set, and their performance."""
    start, end = PERIODS[period]
    d = df.where(F.col(p.time[0]).between(start, end))
    d = research.threshold_signals(d, prediction, **PARAMETERS[parameters])
    return research.performance(d.withColumn("ret", F.col(realised) * p.lag("signal")), p)


