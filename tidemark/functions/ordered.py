"""Order over a whole column without one task that sorts it: quantile buckets, and a calendar by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .slices import below

#: Days of a calendar that is surely small enough to broadcast (two thousand years).
DAYS = 750_000


def running_sums(df: DataFrame, by: Sequence[str], x: str, sums: dict[str, Column | str], buckets: int | None = None) -> DataFrame:
    """``df``, whose x are distinct within ``by``, with the sums over all rows of the same ``by`` up to each x, and ``__next``, the next x.

    Values fall into buckets between approximate quantiles of x; sums run within a bucket and start at what the buckets
    before it hold. The bounds and the buckets' sums are broadcast: ``buckets`` rows for each ``by``, so ``by`` must
    have few values, such as the names of columns.
    """
    buckets = buckets or min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = df.groupBy(*by).agg(F.percentile_approx(x, [i / buckets for i in range(1, buckets)] or [0.5], 10_000).alias("__bounds"))
    at = below(F.col("__bounds"), F.col(x), buckets)
    df = df.join(F.broadcast(bounds), list(by)).withColumn("__bucket", at).drop("__bounds")
    own = {f"__s{i}": F.sum(c) for i, c in enumerate(sums.values())}
    per = df.groupBy(*by, "__bucket").agg(F.min(x).alias("__first"), *[c.alias(n) for n, c in own.items()])
    order = Window.partitionBy(*by).orderBy("__bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "__bucket", F.lead("__first").over(order).alias("__later"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in own])
    w = Window.partitionBy(*by, "__bucket").orderBy(x)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(F.broadcast(per), [*by, "__bucket"])
    out = {name: F.col(f"__s{i}") + F.sum(c).over(upto) for i, (name, c) in enumerate(sums.items())}
    return df.withColumns(out | {"__next": F.coalesce(F.lead(x).over(w), F.col("__later"))}).drop("__bucket", "__later", *own)


def quantiles(counts: DataFrame, by: Sequence[str], x: str, n: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each share): exact quantiles of values x that each occur n times, linear between neighbours. x are distinct within ``by``.

    A quantile lies at a place among all values; only the rows whose occurrences reach the place or the one after it are
    brought together.
    """
    total = counts.groupBy(*by).agg(F.sum(n).alias("__total"))
    run = running_sums(counts, by, x, {"__upto": n}).join(F.broadcast(total), list(by))
    aggs = {}
    for name, share in shares.items():
        place = (F.col("__total") - 1) * F.lit(float(share))  # counted from 0
        low, part = F.floor(place), place - F.floor(place)
        at = F.col("__upto") > low
        here = F.when(at & (F.col("__upto") - F.col(n) <= low), F.col(x))
        after = F.when(F.col("__upto") > low + 1, F.col(x)).otherwise(F.col("__next"))
        aggs[name] = F.max(F.when(here.isNotNull(), F.when((part == 0) | (after == here), here).otherwise(here * (1 - part) + after * part)))
    return run.groupBy(*by).agg(*[c.alias(name) for name, c in aggs.items()])


def by_day(df: DataFrame, time: str, calendar: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with what the calendar's days say of the date in ``time``: some of at, before, after (days) and number (of days so far).

    The calendar is laid out day by day, from one before its first to one after its last; other dates count as these.
    It is joined by date, by broadcast if it is small.
    """
    days = calendar.select(F.col(day).cast("date").alias("__day")).where("__day is not null").distinct()
    low, high = days.agg(F.min("__day"), F.max("__day")).first()
    if low is None:
        nothing = {"number": F.lit(0)}
        return df.withColumns({c: nothing.get(c, F.lit(None).cast("date")) for c in columns})
    spark, n = df.sparkSession, (high - low).days + 3
    every = spark.range(n).select(F.date_add(F.lit(low), F.col("id").cast("int") - 1).alias("__date")).join(days, F.col("__date") == F.col("__day"), "left")
    w = Window.orderBy("__date")  # of a calendar's days only
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.desc("__date")).rowsBetween(Window.unboundedPreceding, -1)
    told = {"at": F.last("__day", ignorenulls=True).over(back), "before": F.last("__day", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "after": F.last("__day", ignorenulls=True).over(ahead), "number": F.count("__day").over(back).cast("int")}
    every = every.select("__date", *[told[c].alias(c) for c in columns])
    held = F.greatest(F.date_sub(F.lit(low), 1), F.least(F.date_add(F.lit(high), 1), F.col(time).cast("date")))
    df = df.withColumn("__date", F.when(F.col(time).isNotNull(), held))
    return df.join(F.broadcast(every) if n <= DAYS else every, "__date", "left").drop("__date")
