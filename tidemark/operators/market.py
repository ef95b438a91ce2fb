"""Market reviews by month: gaps of highs and lows, moves of price and volume, lengths of suspensions in trading days.

Each review has a row for every month and one over all, whose month is NULL; both come from one aggregation. The one over
all is there, with a count of 0, where no row is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.panel import Panel, div
from .joins import between_ordinals


def _reviewed(df: DataFrame, day: str, stats: dict[str, Column]) -> DataFrame:
    """Rows and statistics by month of the year, and over all. Rows without a day are left out."""
    d = df.where(F.col(day).isNotNull()).withColumn("month", F.month(day))
    got = d.rollup("month").agg(F.count("*").alias("n"), *[c.alias(n) for n, c in stats.items()])
    # Spark's ROLLUP of no rows is empty, the standard's has the row over all
    over_all = df.sparkSession.range(1).select(F.lit(None).cast("int").alias("__all"))
    got = got.join(over_all, F.col("month").eqNullSafe(F.col("__all")), "full")  # thirteen rows at most
    return got.select("month", F.coalesce("n", F.lit(0)).alias("n"), *stats)


def _moments(names: Sequence[str], median: Sequence[str] = ()) -> dict[str, Column]:
    out = {f"{n}_{k}": f(n) for n in names for k, f in (("mean", F.avg), ("std", F.stddev_samp))}
    return out | {f"{n}_median": F.median(n) for n in median}


def price_gaps(df: DataFrame, o: str, h: str, low: str, c: str, volume: str, value: str, before: str, suspended: Column) -> DataFrame:
    """What a quote's high and low leave over its open and close, value against volume at the close, open against the close before.

    ``high_gap`` and ``low_gap`` in prices and percent, ``value_factor`` (value over volume times close),
    ``average_factor`` (mean price over close) and ``open_noise``, each as percent above or below. Only quotes with
    four positive prices that are not suspended; an unknown state is not a suspension.
    """
    d = df.where((F.least(o, h, low, c) > 0) & F.nvl(~suspended, F.lit(True)))
    d = d.where(F.col(o).isNotNull() & F.col(h).isNotNull() & F.col(low).isNotNull() & F.col(c).isNotNull())
    d = d.withColumns({"high_gap": F.col(h) - F.greatest(o, c), "low_gap": F.least(o, c) - F.col(low)})
    at_close = F.col(volume) * F.col(c)
    return d.withColumns({
        "high_gap_pct": F.col("high_gap") / F.greatest(o, c) * 100, "low_gap_pct": F.col("low_gap") / F.least(o, c) * 100,
        "value_factor": div(F.col(value) - at_close, at_close) * 100, "average_factor": (div(value, volume) / F.col(c) - 1) * 100,
        "open_noise": (div(o, before) - 1) * 100,
    })


def price_gap_months(df: DataFrame, day: str, *columns: str, suspended: Column) -> DataFrame:
    """Mean and deviation of what ``price_gaps`` finds, by month and over all; of the opening noise also the median."""
    names = ["high_gap", "high_gap_pct", "low_gap", "low_gap_pct", "value_factor", "average_factor", "open_noise"]
    return _reviewed(price_gaps(df, *columns, suspended), day, _moments(names, ["open_noise"]))


def volume_price_months(df: DataFrame, p: Panel, day: str, o: str, c: str, volume: str, suspended: Column) -> DataFrame:
    """Volume, move from open to close and change of volume (percent), by month and over all.

    Quotes with volume and prices that are not suspended. The change is that to the series' last such quote, never that to
    another series.
    """
    d = df.where((F.col(volume) > 0) & (F.col(o) > 0) & (F.col(c) > 0) & F.nvl(~suspended, F.lit(True)))
    d = d.withColumns({"volume": F.col(volume), "move": (F.col(c) / F.col(o) - 1) * 100, "volume_change": (div(volume, p.lag(volume)) - 1) * 100})
    return _reviewed(d, day, _moments(["volume", "move", "volume_change"], ["volume", "move"]))


def suspension_lengths(df: DataFrame, calendar: DataFrame, start: str = "SuspendDate", end: str = "ResumptionDate", day: str = "day") -> DataFrame:
    """``df`` with ``trading_days`` (of the calendar, both ends counted) and ``natural_days``, without those that have not ended or end before they start."""
    d = df.where(F.col(end) >= F.col(start))
    return between_ordinals(d, calendar, start, end, day).withColumn("natural_days", F.datediff(end, start))


def suspension_length_months(lengths: DataFrame, start: str = "SuspendDate") -> DataFrame:
    """Mean, deviation, least and most trading days, mean and deviation of natural days, by month of the start and over all."""
    return _reviewed(lengths, start, _moments(["trading_days", "natural_days"]) | {"trading_days_min": F.min("trading_days"), "trading_days_max": F.max("trading_days")})


def day_marks(df: DataFrame, suspensions: DataFrame, factors: DataFrame, by: str, day: str, start: str = "SuspendDate", end: str = "ResumptionDate", since: str = "ExDiviDate") -> DataFrame:
    """``df`` with ``suspended_on``, ``resumed_on`` and ``factor_changed``: whether the key's day starts or ends a suspension or has a new adjusting factor.

    The three kinds of events become one row for each key and day before the join, so rows never multiply and the quotes
    are exchanged once. Events without a day, and quotes without one, match nothing: all three are false.
    """
    kinds = ("suspended_on", "resumed_on", "factor_changed")
    events = [(suspensions, start), (suspensions, end), (factors, since)]
    rows = [e.select(F.col(by), F.col(c).cast("date").alias(day), *[F.lit(k == i).alias(n) for k, n in enumerate(kinds)]) for i, (e, c) in enumerate(events)]
    marks = rows[0].unionByName(rows[1]).unionByName(rows[2]).dropna().groupBy(by, day).agg(*[F.bool_or(n).alias(n) for n in kinds])
    return df.join(marks, [by, day], "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in kinds})


def change_review(df: DataFrame, day: str, change: str, resumed: str = "resumed_on") -> DataFrame:
    """Changes in percent by month and over all (NULL month), of all quotes and of the days of resumption alone (``scope``).

    Moments, quartiles (exact, linear), directions, limits (9.8) and sizes: small up to 1, medium up to 5, large below the
    limits, ``high`` from 8 up. ``n`` counts all quotes of the scope, ``valid`` those with a change.
    """
    x = F.col(change)
    size = F.abs(x)
    d = df.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col(resumed), "resumed")))))
    stats = {"valid": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "least": F.min(x), "most": F.max(x)}
    stats |= {n: F.percentile(x, q) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))}
    counted = {"up": x > 0, "down": x < 0, "unchanged": x == 0, "limit_up": x >= 9.8, "limit_down": x <= -9.8, "high": x >= 8, "small": size <= 1, "medium": (size > 1) & (size <= 5), "large": (size > 5) & (size < 9.8)}
    d = d.where(F.col(day).isNotNull()).withColumn("month", F.trunc(day, "month"))
    return d.groupingSets([["scope", "month"], ["scope"]], "scope", "month").agg(F.count("*").alias("n"), *[c.alias(n) for n, c in stats.items()], *[F.count_if(c).alias(n) for n, c in counted.items()])


def large_moves(df: DataFrame, change: str, least: float = 8.0, marks: Sequence[str] = ("suspended_on", "resumed_on", "factor_changed")) -> DataFrame:
    """Quotes that rose by ``least`` percent or more, with ``told``: which of the day's marks hold, joined by commas, or 'none'."""
    names = F.concat_ws(",", *[F.when(F.col(m), F.lit(m)) for m in marks])
    return df.where(F.col(change) >= least).withColumn("told", F.when(names == "", "none").otherwise(names))
