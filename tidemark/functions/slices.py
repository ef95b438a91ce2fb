"""Long series in more than one task: slices by time, halos for windows, carried prefixes, scans of linear recurrences.

A series of more than ``rows`` rows is cut between approximate quantiles of its time into slices of about so many. Windows
of a bounded number of rows see a slice with a halo of its neighbours' rows; running values start at what the slices
before amount to; a recursive mean is a linear function of the state before a slice, so each slice is summed up by itself,
the states are passed along a list of slices, and each slice is run from its own. The bounds are collected once, at most
SLICES of them over all series, so that every use of them cuts alike. Series that are short stay whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .panel import Decayed, Panel, ema, series_edges

#: Rows of a slice, and slices over all series at most (then they get longer).
ROWS, SLICES = 1_000_000, 20_000


def below(bounds: Column, x: Column, most: int) -> Column:
    """How many of an ordered array's elements (``most`` at most) are less than x, by halving."""
    steps = [1 << i for i in reversed(range(max(1, most).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda i, s: i + F.when(F.try_element_at(bounds, i + s) < x, s).otherwise(0))


def _same(by: Sequence[str], prefix: str = "__k_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in by], F.lit(True))


@dataclass
class Slices:
    """``df`` has ``__slice`` (0 for short series); ``starts`` has, for each long series, the first row of each of its slices and their end."""

    df: DataFrame
    panel: Panel
    starts: dict[tuple, list[int]]
    #: Adds ``__slice`` to other rows of the same series, by a time of theirs.
    cut: Callable[[DataFrame, str], DataFrame]
    #: For each long series, what its slices but the last reach up to.
    bounds: dict[tuple, list]

    @property
    def inner(self) -> Panel:
        return Panel((*self.panel.by, "__slice"), self.panel.time)

    def _told(self, df: DataFrame, schema: list[T.StructField], values: Callable[[tuple, list[int]], list[tuple]], inner: bool) -> DataFrame:
        """``df`` with what is held for each long series (and slice)."""
        by, spark = list(self.panel.by), df.sparkSession
        keys = [T.StructField(f"__k_{c}", self.df.schema[c].dataType) for c in by]
        rows = [(*k, *v) for k, starts in self.starts.items() for v in values(k, starts)]
        held = F.broadcast(spark.createDataFrame(rows, T.StructType([*keys, *schema])))
        on = _same(by) & (F.col("__slice") == F.col("__at")) if inner else _same(by)
        return df.join(held, on, "left").drop(*[k.name for k in keys], "__at")

    def numbered(self) -> DataFrame:
        """With ``__row``, the row's place in its series, from 0."""
        if not self.starts:
            return self.df.withColumn("__row", F.row_number().over(self.inner.w).cast("long") - 1)
        at = [T.StructField("__at", T.IntegerType()), T.StructField("__start", T.LongType())]
        df = self._told(self.df, at, lambda _, s: [(i, n) for i, n in enumerate(s[:-1])], True)
        return df.withColumn("__row", F.coalesce("__start", F.lit(0)) + F.row_number().over(self.inner.w) - 1).drop("__start")

    def with_halo(self, before: int, after: int = 0) -> DataFrame:
        """Each slice's rows, ``__own``, and copies of so many rows before and after it."""
        df = self._told(self.numbered(), [T.StructField("__starts", T.ArrayType(T.LongType()))], lambda _, s: [(s,)], False)
        starts, row, k = F.col("__starts"), F.col("__row"), F.col("__slice")
        numbers = F.sequence(F.lit(0), F.size(starts) - 2)
        ahead = F.filter(numbers, lambda i: (i > k) & (row >= F.get(starts, i) - before))
        back = F.filter(numbers, lambda i: (i < k) & (row < F.get(starts, i + 1) + after))
        none = F.array().cast("array<int>")
        first, end = F.get(starts, k), F.get(starts, k + 1)
        to = F.concat(F.array(k), F.when(row >= end - before, ahead).otherwise(none), F.when(row < first + after, back).otherwise(none))
        out = df.withColumns({"__was": k, "__to": F.coalesce(to, F.array(k))}).drop("__starts", "__slice").withColumn("__slice", F.explode("__to"))
        return out.withColumn("__own", F.col("__slice") == F.col("__was")).drop("__was", "__to")


def sliced(df: DataFrame, panel: Panel, rows: int = ROWS) -> Slices:
    """Cut the long series of ``df``. Rows of one time stay together; NULL times come first."""
    by, t = list(panel.by), panel.time[0]
    size = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.sum("n").alias("all")).first()
    rows = max(rows, (size["all"] or 0) // SLICES)
    if (size["n"] or 0) <= rows:
        return Slices(df.withColumn("__slice", F.lit(0)), panel, {}, lambda d, _: d.withColumn("__slice", F.lit(0)), {})
    pieces = -(-size["n"] // rows)
    step = F.greatest(F.lit(1), F.floor(pieces / F.ceil(F.col("n") / rows)))
    told = df.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(t, [i / pieces for i in range(1, pieces)], 20 * pieces).alias("b")).where(F.col("n") > rows)
    held = told.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.array_distinct(F.filter("b", lambda x, i: (i + 1) % step == 0)).alias("__bounds"))
    rows_of = held.collect()
    local = df.sparkSession.createDataFrame(rows_of, held.schema)

    def placed(d: DataFrame, time: str) -> DataFrame:
        at = F.when(F.col("__bounds").isNotNull(), below(F.col("__bounds"), F.col(time), pieces)).otherwise(0)
        return d.join(F.broadcast(local), _same(by), "left").withColumn("__slice", at).drop(*[f"__k_{c}" for c in by])

    both = placed(df, t)
    count: dict[tuple, dict[int, int]] = {}
    for r in both.where("__bounds is not null").groupBy(*by, "__slice", F.size("__bounds").alias("__b")).agg(F.count("*").alias("n")).collect():
        count.setdefault(tuple(r[c] for c in by), dict.fromkeys(range(r["__b"] + 1), 0))[r["__slice"]] = r["n"]
    starts = {k: [0, *np.cumsum(list(n.values())).tolist()] for k, n in count.items()}
    return Slices(both.drop("__bounds"), panel, starts, lambda d, time: placed(d, time).drop("__bounds"), {tuple(r[:-1]): r[-1] for r in rows_of})


def in_slices(df: DataFrame, panel: Panel, then: Callable[[DataFrame, Panel], DataFrame], before: int, after: int = 0, rows: int = ROWS) -> DataFrame:
    """``then(df, panel)``, long series slice by slice: right for windows of ``before`` rows before and ``after`` rows after the current one.

    ``then`` adds columns, keeping those that it is given.
    """
    s = sliced(df, panel, rows)
    if not s.starts:
        return then(df, panel)
    return then(s.with_halo(before, after), s.inner).where("__own").drop("__own", "__slice", "__row")


def numbered(df: DataFrame, panel: Panel, rows: int = ROWS) -> DataFrame:
    """With ``__row``, the row's place in its series, from 0; no task orders more than a slice."""
    return sliced(df, panel, rows).numbered().drop("__slice")


RUNNING = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
}


def running(df: DataFrame, panel: Panel, values: dict[str, tuple[str, Column | str]], rows: int = ROWS) -> DataFrame:
    """Adds {output: (sum, count, min, max or last known, column)} over the series so far; long series by slices and carried prefixes."""
    values = {n: (k, F.col(x) if isinstance(x, str) else x) for n, (k, x) in values.items()}
    s = sliced(df, panel, rows)
    own = {n: RUNNING[k][0](x).over(s.inner.so_far) for n, (k, x) in values.items()}
    if not s.starts:
        return s.df.withColumns(own).drop("__slice")
    order = F.struct(*panel.time)
    total = {n: F.max_by(x, F.when(x.isNotNull(), order)) if k == "last" else RUNNING[k][0](x) for n, (k, x) in values.items()}
    by = list(panel.by)
    per = s.df.groupBy(*by, "__slice").agg(*[c.alias(f"__c_{n}") for n, c in total.items()])
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # of slices
    again = {n: "sum" if k == "count" else k for n, (k, _) in values.items()}
    carried = per.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__slice").alias("__at"), *[RUNNING[again[n]][0](F.col(f"__c_{n}")).over(before).alias(f"__c_{n}") for n in values])
    # a row for each slice and for each short series: not broadcast by itself
    out = s.df.withColumns({f"__o_{n}": c for n, c in own.items()}).join(carried, _same(by) & (F.col("__slice") == F.col("__at")), "left")
    out = out.withColumns({n: RUNNING[k][1](F.col(f"__o_{n}"), F.col(f"__c_{n}")) for n, (k, _) in values.items()})
    return out.select(*df.columns, *values)


class _Effect:
    """What a slice does to an exponential mean: its state at the end as a function of the one before it."""

    def __init__(self, span: float, adjust: bool):
        self.span, self.adjust, self.rows, self.lead, self.seed = span, adjust, 0, 0, None
        self.runs = [Decayed(span, adjust)] if adjust else []

    def add(self, x: np.ndarray) -> None:
        self.rows += len(x)
        if self.adjust:
            self.runs[0].add(x)
            return
        if self.seed is None:
            known = np.flatnonzero(~np.isnan(x))
            if not len(known):
                self.lead += len(x)
                return
            self.lead, self.seed, x = self.lead + int(known[0]), float(x[known[0]]), x[known[0] + 1 :]
            self.runs = [Decayed(self.span, False) for _ in range(2)]
            for mean, run in zip((0.0, 1.0), self.runs, strict=True):
                run.mean = mean
        if len(x):
            for run in self.runs:
                run.add(x)

    def told(self) -> list[float | None]:
        if self.adjust:
            return [float(self.rows), *self.runs[0].sums, None, None, None]
        if self.seed is None:
            return [float(self.rows), None, None, None, None, None]
        zero, one = (run.mean for run in self.runs)
        return [float(self.rows), float(self.lead), self.seed, one - zero, zero, float(self.runs[0].gap)]


def _after(span: float, adjust: bool, state: tuple | None, told: Sequence[float | None]) -> tuple | None:
    """The state after a slice: sums of values and of ones, or the mean and the rows since it was last fed."""
    alpha = 2 / (span + 1)
    if adjust:
        rows, up, down = told[:3]
        keep = (1 - alpha) ** rows
        return keep * (state[0] if state else 0.0) + up, keep * (state[1] if state else 0.0) + down
    rows, lead, seed, slope, zero, gap = told
    if seed is None:
        return (state[0], state[1] + int(rows)) if state else None
    weight = (1 - alpha) ** (state[1] + lead + 1) if state else 0.0
    first = (weight * state[0] + alpha * seed) / (weight + alpha) if state else seed
    return slope * first + zero, int(gap)


def ema_in_slices(df: DataFrame, panel: Panel, spans: dict[str, tuple[str | tuple[str, str], float]], adjust: bool = False, rows: int = ROWS) -> DataFrame:
    """As ``ema``; long series are run slice by slice, once to sum each up and once from its own state.

    An output that is made of another one needs that one first, so each level of these takes two passes of its own.
    """
    s = sliced(df, panel, rows)
    if not s.starts:
        return ema(df, panel, spans, adjust)
    out, done, by = s.df, set(), list(s.inner.by)
    longs = set(s.starts)
    while len(done) < len(spans):
        made = set(spans) - done
        level = {n: v for n, v in spans.items() if n in made and not ({v[0]} if isinstance(v[0], str) else set(v[0])) & made}
        names = list(level)

        def effects(batches, level=level, names=names):
            held: dict[str, _Effect] = {}
            key = None
            for batch, cuts, begins, keys in series_edges(batches, by):
                inputs = {c: batch.column(batch.schema.get_field_index(c)).cast("double").to_numpy(zero_copy_only=False) for c in {c for x, _ in level.values() for c in ([x] if isinstance(x, str) else x)}}
                for a, b, new, k in zip(cuts[:-1], cuts[1:], begins, keys, strict=True):
                    if new:
                        if key is not None:
                            yield told(key, held)
                        held, key = {n: _Effect(span, adjust) for n, (_, span) in level.items()}, k
                    for n, (x, _) in level.items():
                        held[n].add(inputs[x][a:b] if isinstance(x, str) else inputs[x[0]][a:b] - inputs[x[1]][a:b])
            if key is not None:
                yield told(key, held)

        def told(key, held, names=names):
            cols = [pa.array([v], t) for v, t in zip(key, arrow, strict=True)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([[held[n].told() for n in names]], pa.list_(pa.list_(pa.float64())))], names=[*by, "__told"])

        from pyspark.sql.pandas.types import to_arrow_type

        fields = [out.schema[c] for c in by]
        arrow = [to_arrow_type(f.dataType) for f in fields]
        ordered = s._told(out, [T.StructField("__long", T.BooleanType())], lambda *_: [(True,)], False).where("__long").drop("__long").repartition(*by).sortWithinPartitions(*by, *panel.time)
        summed = ordered.mapInArrow(effects, T.StructType([*fields, T.StructField("__told", T.ArrayType(T.ArrayType(T.DoubleType())))]))
        per: dict[tuple, dict[int, list]] = {}
        for r in summed.collect():  # a row for each slice of a long series
            per.setdefault(tuple(r[:-2]), {})[r[-2]] = r[-1]
        states: dict[tuple, dict[str, tuple]] = {}
        for k in longs:
            now: dict[str, tuple | None] = dict.fromkeys(names)
            for at in sorted(per.get(k, {})):
                states[(*k, at)] = dict(now)
                now = {n: _after(level[n][1], adjust, now[n], t) for n, t in zip(names, per[k][at], strict=True)}
        out = ema(out, s.inner, level, adjust, states)
        done |= set(level)
    return out.drop("__slice")
