"""Window expressions over a panel of series.

A panel is keyed by a series and ordered by time. All expressions of one panel share one window specification, so Spark
plans one exchange and one sort for any number of them. Missing is NULL; a division by zero is NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """NULL where the divisor is zero or either side is NULL."""
    return F.try_divide(col(a), col(b))


def ln(x) -> Column:
    """NULL unless positive."""
    return F.when(col(x) > 0, F.ln(col(x)))


def root(x) -> Column:
    """NULL where negative."""
    return F.when(col(x) >= 0, F.sqrt(col(x)))


def flag(condition: Column) -> Column:
    """1 or 0; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


@dataclass(frozen=True)
class Panel:
    """``by``: the series' key columns, ``time``: what orders a series."""

    by: tuple[str, ...] = ("SecuCode",)
    time: tuple[str, ...] = ("TradingDay",)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.time)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.by)

    def last_n(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def from_here(self) -> WindowSpec:
        """The rows from this one on, the last first: Spark would read a frame that ends with the series anew for every row.

        Within equal times the order need not be the opposite of ``w``'s.
        """
        return Window.partitionBy(*self.by).orderBy(*[F.col(t).desc_nulls_last() for t in self.time]).rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.w)

    def lead(self, x, n: int = 1) -> Column:
        return F.lead(col(x), n).over(self.w)

    def roll(self, agg, x, n: int, least: int | None = None) -> Column:
        """``agg`` over the last n rows, once ``least`` (n) of them are known."""
        x = col(x)
        return F.when(F.count(x).over(self.last_n(n)) >= (n if least is None else least), agg(x).over(self.last_n(n)))

    def mean(self, x, n: int) -> Column:
        return self.roll(F.avg, x, n)

    def std(self, x, n: int) -> Column:
        return self.roll(F.stddev_samp, x, n)

    def total(self, x, n: int) -> Column:
        return self.roll(F.sum, x, n)

    def low(self, x, n: int) -> Column:
        return self.roll(F.min, x, n)

    def high(self, x, n: int) -> Column:
        return self.roll(F.max, x, n)

    def corr(self, x, y, n: int) -> Column:
        """Rolling correlation by covariance, NULL without variance."""
        both = col(x).isNotNull() & col(y).isNotNull()
        x, y, r = F.when(both, col(x)), F.when(both, col(y)), self.last_n(n)
        return F.when(F.count(x).over(r) == n, div(F.covar_samp(x, y).over(r), F.stddev_samp(x).over(r) * F.stddev_samp(y).over(r)))

    def slope(self, x, n: int) -> Column:
        """Least-squares slope over the last n rows against their number; needs a ``row_number`` column ``__n``."""
        r = self.last_n(n)
        return F.when(F.count(col(x)).over(r) == n, F.regr_slope(col(x), F.col("__n")).over(r))

    def numbered(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__n", F.row_number().over(self.w).cast("double"))

    def pct(self, x, n: int = 1) -> Column:
        return div(x, self.lag(x, n)) - 1

    def diff(self, x, n: int = 1) -> Column:
        return col(x) - self.lag(x, n)

    def ffill(self, x) -> Column:
        return F.last(col(x), ignorenulls=True).over(self.so_far)

    def bfill(self, x) -> Column:
        return F.last(col(x), ignorenulls=True).over(self.from_here)

    def zscore(self, x, n: int) -> Column:
        return div(col(x) - self.mean(x, n), self.std(x, n))

    def growth(self, r) -> Column:
        """Running product of 1 + r, for r above -1."""
        return F.exp(F.sum(F.ln(1 + col(r))).over(self.so_far))


class Decayed:
    """An exponential mean that is fed a series piece by piece, from the start or from a state: the mean and the rows since its last value, or both decayed sums."""

    def __init__(self, span: float, adjust: bool, state: tuple | None = None):
        self.alpha, self.adjust = 2 / (span + 1), adjust
        self.mean, self.gap, self.sums = None, 0, (0.0, 0.0)
        if state is not None:
            self.mean, self.gap, self.sums = (None, 0, state) if adjust else (*state, self.sums)

    def _run(self, seed: list[float], x: np.ndarray) -> np.ndarray:
        import pandas as pd

        return pd.Series(np.concatenate([seed, x])).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[len(seed) :]

    def add(self, x: np.ndarray) -> np.ndarray:
        """The means at each of x; a gap repeats the last one, and what came before it weighs less after it."""
        known = ~np.isnan(x)
        if self.adjust:  # decayed sums of values and of ones
            up, down = (self._run([s], v / self.alpha) for s, v in zip(self.sums, (np.where(known, x, 0.0), known.astype(float)), strict=True))
            self.sums = float(up[-1]), float(down[-1])
            return np.divide(up, down, out=np.full(len(x), np.nan), where=down > 0)
        most = 1 if self.alpha >= 1 else int(-750 / math.log1p(-self.alpha)) + 1  # beyond it nothing is left of the weight
        out = self._run([] if self.mean is None else [self.mean, *[np.nan] * min(self.gap, most)], x)
        if known.any():
            self.mean, self.gap = float(out[-1]), int(np.argmax(known[::-1]))
        else:
            self.gap += len(x)
        return out


def series_edges(batches, by: Sequence[str]):
    """Of ordered Arrow batches: each one, where its runs of one series are cut, which of these begin a series, and their keys."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        series = [batch.column(batch.schema.get_field_index(c)) for c in by]
        edge = np.zeros(batch.num_rows, bool)
        for c in series:
            code = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            edge[1:] |= code[1:] != code[:-1]
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(edge), [batch.num_rows]]))
        keys = [tuple(c[int(a)].as_py() for c in series) for a in cuts[:-1]]
        begins = [last is None or keys[0] != last, *[True] * (len(keys) - 1)]
        last = keys[-1]
        yield batch, cuts, begins, keys


def ema(df: DataFrame, panel: Panel, spans: dict[str, tuple[str | tuple[str, str], float]], adjust: bool = False, states: dict[tuple, dict[str, tuple | None]] | None = None) -> DataFrame:
    """Adds exponential means: {output: (input, span)}, seeded by the first value, weights decaying over gaps too.

    An input is a column, an earlier output, or the difference of two of these. Recursive, so each series is folded by one
    task, all outputs in one pass: rows come in order in Arrow batches, of which only the inputs are looked at, and only
    the means are carried from one to the next (``slices.ema_in_slices`` runs a long series in several tasks). ``states``:
    for some series, what their outputs' means start from.
    """
    from pyspark.sql import types as T

    by, names = list(panel.by), list(spans)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def fold(batches):
        means = {}
        for batch, cuts, begins, keys in series_edges(batches, by):
            held = {c: batch.column(batch.schema.get_field_index(c)).cast("double").to_numpy(zero_copy_only=False) for c in {c for x, _ in spans.values() for c in ([x] if isinstance(x, str) else x)} - set(names)}
            held |= {n: np.empty(batch.num_rows) for n in names}
            for a, b, new, key in zip(cuts[:-1], cuts[1:], begins, keys, strict=True):
                if new:
                    start = (states or {}).get(key, {})
                    means = {n: Decayed(span, adjust, start.get(n)) for n, (_, span) in spans.items()}
                for n, (x, _) in spans.items():
                    held[n][a:b] = means[n].add(held[x][a:b] if isinstance(x, str) else held[x[0]][a:b] - held[x[1]][a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(held[n], from_pandas=True) for n in names)], names=[*batch.schema.names, *names])

    return df.repartition(*by).sortWithinPartitions(*by, *panel.time).mapInArrow(fold, schema)


def rolling_apply(panel: Panel, x, n: int, fn) -> Column:
    """A function of the last n values, given as a pandas series, once there are n: for what no built-in aggregate says.

    Windows go to Python as Arrow batches; built-in aggregates (``Panel.roll``) are faster.
    """
    import pandas as pd

    def run(values: pd.Series) -> float:
        return float(fn(values))

    run.__annotations__ = {"values": pd.Series, "return": float}
    return F.when(F.count(col(x)).over(panel.last_n(n)) >= n, F.pandas_udf(run, "double")(col(x)).over(panel.last_n(n)))


def ema_sql(panel: Panel, x, span: float, n: int) -> Column:
    """As ``ema`` in plain Spark, by a fold over the last n values; for short series or where the weight beyond n is nothing."""
    a = 2.0 / (span + 1)
    held = F.collect_list(col(x).cast("double")).over(panel.last_n(n))
    return F.aggregate(held, F.lit(None).cast("double"), lambda e, v: F.coalesce(e * (1 - a) + v * a, v))
