"""Estimates of missing opening prices: from the previous close by a ratio, with or without noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.panel import div


def noise(keys: Sequence[str], seed: int = 42) -> Column:
    """A number from -1 to 1 that the row's keys decide, so reruns and other partitionings give the same."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**31 - 1


def ratio_stats(df: DataFrame, opened: str, before: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median and deviation of open over previous close."""
    return df.withColumn("__r", div(opened, before)).groupBy(*by).agg(F.avg("__r").alias("mean_ratio"), F.median("__r").alias("median_ratio"), F.stddev_samp("__r").alias("ratio_std"))


def opening_estimates(df: DataFrame, keys: Sequence[str], opened: str, before: str, sector: str, floor: str, ceiling: str, seed: int = 42) -> DataFrame:
    """The rows without an opening price, with eleven estimates of it.

    fill_previous: the previous close. fill_mean, fill_median, fill_sector: times the mean, the median or the sector's
    mean ratio. fill_random: the mean ratio and noise of a deviation. fill_limited: fill_mean within floor and ceiling.
    noise_tight, noise_std, noise_wide, noise_sector: the previous close moved by at most 0.1 %, a deviation, 1.2 %, the
    sector's deviation. noise_mixed: the mean ratio moved by at most a deviation.
    """
    whole = ratio_stats(df, opened, before)
    own = ratio_stats(df, opened, before, [sector]).select(F.col(sector).alias("__sector"), F.col("mean_ratio").alias("__own"), F.col("ratio_std").alias("__own_std"))
    d = df.where(F.col(opened).isNull()).join(F.broadcast(whole), how="cross").join(own, F.col(sector) == F.col("__sector"), "left")  # one row
    x, m, s, u = F.col(before), F.col("mean_ratio"), F.col("ratio_std"), noise(keys, seed)
    made = {
        "fill_previous": x,
        "fill_mean": x * m,
        "fill_median": x * F.col("median_ratio"),
        "fill_sector": x * F.col("__own"),
        "fill_random": x * (m + s * u),
        "fill_limited": F.when(x.isNotNull(), F.least(F.greatest(x * m, F.col(floor)), F.col(ceiling))),
        "noise_tight": x * (1 + 0.001 * u),
        "noise_std": x * (1 + s * u),
        "noise_wide": x * (1 + 0.012 * u),
        "noise_sector": x * (1 + F.col("__own_std") * u),
        "noise_mixed": x * (m + s * u),
    }
    return d.withColumns(made).drop("__sector", "__own", "__own_std", "mean_ratio", "median_ratio", "ratio_std")
