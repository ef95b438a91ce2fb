"""Joins of panels: as-of, point in time, a year ago, event flags, alignment to a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import by_day
from ..functions.panel import Panel


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], default: dict | None = None) -> DataFrame:
    """``left`` with the right row's ``columns`` of the latest time not after its own; ``default`` where there is none.

    A union and one window: each right row sorts before the left rows of its time, and the last known one is carried on.
    No range join, one exchange on ``by``. Right rows of equal key and time: the largest values count.
    """
    names = [f"__l{i}" for i in range(len(left.columns))]
    wide = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(left.columns, names, strict=True)])
    held = F.struct(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(columns)])
    one = right.where(F.col(right_time).isNotNull()).groupBy(*by, F.col(right_time).alias("__t")).agg(F.max(held).alias("__held"))
    both = left.select(*by, F.col(left_time).alias("__t"), wide.alias("__row"), F.lit(1).alias("__side")).unionByName(one.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("__last", F.last("__held", ignorenulls=True).over(w)).where("__side = 1")
    out = []
    for i, c in enumerate(columns):
        x = F.col(f"__last.__r{i}")
        out.append((F.coalesce(x, F.lit(default[c])) if default and c in default else x).alias(c))
    return got.select(*[F.col(f"__row.{n}").alias(c) for c, n in zip(left.columns, names, strict=True)], *out)


def event_flag(df: DataFrame, events: DataFrame, by: Sequence[str], time: str, event_time: str, name: str) -> DataFrame:
    """0/1: whether an event of the same key falls on the row's day. Events are made distinct first, so rows never multiply."""
    keys = events.select(*by, F.col(event_time).alias(time), F.lit(1).alias(name)).distinct()
    return df.join(keys, [*by, time], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def year_ago(df: DataFrame, by: Sequence[str], time: str, columns: Sequence[str], months: int = 12) -> DataFrame:
    """``df`` with each column's value at the same date a year before, as ``{column}_ago``."""
    before = df.select(*by, F.add_months(time, months).alias(time), *[F.col(c).alias(f"{c}_ago") for c in columns])
    return df.join(before, [*by, time], "left")


def aligned(df: DataFrame, key: str, time: str, columns: Sequence[str], how: str = "ffill") -> DataFrame:
    """Every key at every time that any key has, gaps filled within the key: ffill, bfill, interpolate or none."""
    keys, times = df.select(key).distinct(), df.select(time).distinct()
    # the grid is the result itself: as many rows as keys times dates
    grid = keys.join(times, how="cross").join(df.select(key, time, *columns), [key, time], "left")
    p = Panel((key,), (time,))
    if how in ("ffill", "bfill"):
        fill = p.ffill if how == "ffill" else p.bfill
        return grid.withColumns({c: fill(c) for c in columns})
    if how == "interpolate":
        return interpolated(grid, [key], [time], columns)
    return grid


def interpolated(df: DataFrame, by: Sequence[str], time: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Gaps filled along a line by row number; after the last known value that stays, before the first nothing is known."""
    w = Window.partitionBy(*by).orderBy(*time)
    df = df.withColumn("__i", F.row_number().over(w))
    back, on = Panel(tuple(by), ("__i",)).so_far, Panel(tuple(by), ("__i",)).from_here
    new = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("__i"))
        p, q, i, j = F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(on), F.last(at, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(on)
        new[c] = F.when(F.col(c).isNotNull() | q.isNull(), p).when(p.isNotNull(), p + (q - p) * F.try_divide((F.col("__i") - i).cast("double"), j - i))
    return df.withColumns(new).drop("__i")


def between_ordinals(df: DataFrame, calendar: DataFrame, start: str, end: str, day: str = "day", name: str = "trading_days") -> DataFrame:
    """Trading days from ``start`` to ``end``, both included if they trade: a difference of two days' numbers. A missing date counts as one before all."""
    df = df.withColumn("__before", F.date_sub(start, 1))
    df = by_day(df, end, calendar, day, ["number"]).withColumnRenamed("number", "__to")
    df = by_day(df, "__before", calendar, day, ["number"]).withColumnRenamed("number", "__from")
    return df.withColumn(name, F.coalesce("__to", F.lit(0)) - F.coalesce("__from", F.lit(0))).drop("__before", "__to", "__from")


def since(df: DataFrame, events: DataFrame, by: Sequence[str], time: str, event_time: str) -> DataFrame:
    """``df`` with every event of its key up to its time: one row for each, or one without. An equi-join with a residual condition.

    Rows multiply by the events before them; where the latest is meant, ``asof`` does not.
    """
    e = events.withColumnsRenamed({c: f"__e_{c}" for c in by})
    on = [F.col(c) == F.col(f"__e_{c}") for c in by]
    return df.join(e, [*on, F.col(time) >= F.col(event_time)], "left").drop(*[f"__e_{c}" for c in by])


def either(df: DataFrame, columns: Sequence[str], values: DataFrame, value: str) -> DataFrame:
    """Rows of which one of ``columns`` is among the values: a semi-join for each column, on what the ones before it left."""
    v, out, left = values.select(F.col(value).alias("__v")).where("__v IS NOT NULL").distinct(), None, df
    for c in columns:
        hit = left.join(v, F.col(c) == F.col("__v"), "left_semi")
        out, left = hit if out is None else out.unionByName(hit), left.join(v, F.col(c) == F.col("__v"), "left_anti")
    return out


def new_listings(quotes: DataFrame, securities: DataFrame, limits: DataFrame, states: DataFrame, code: str, day: str, listed: str, start: str, end: str) -> DataFrame:
    """Quotes of securities listed from ``start`` to ``end``, from their listing to ``end``, with limits, state and days since the listing."""
    s = securities.where(F.col(listed).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    d = quotes.join(s, code).where(F.col(day).between(F.col(listed), F.lit(end).cast("date")))
    d = d.join(limits, [code, day], "left").join(states, [code, day], "left")
    return d.withColumn("days_listed", F.datediff(day, listed))


def quality_scan(quotes: DataFrame, limits: DataFrame, performance: DataFrame, securities: DataFrame, code: str, day: str, start: str, end: str, markets: Sequence[int] = (83, 90), category: int = 1, state: int = 1) -> DataFrame:
    """Quotes from ``start`` to ``end`` of listed shares of these markets, with the day's limits and state and the share's listing.

    The dates go to the scan of all three daily tables, the securities' condition to theirs; daily tables meet on (code,
    day). Quotes without limits or state keep NULLs; those of other securities, or unknown ones, are left out.
    """
    span = lambda t: t.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    s = securities.where((F.col("SecuCategory") == category) & (F.col("ListedState") == state) & F.col("SecuMarket").isin(*markets))
    daily = span(quotes).join(span(limits), [code, day], "left").join(span(performance), [code, day], "left")
    return daily.join(s, code)
