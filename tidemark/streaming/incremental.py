"""Running values of each series, kept in the state store.

One processor folds a series' rows in time order within each micro-batch. The order between micro-batches is the
source's: a row that arrives after later ones of its series is folded then, as a running value can't be undone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

STATE = "n long, ma double, ema double, var double, low double, high double, total double, xs array<double>, ys array<double>"
SINGLE = ("n", "ma", "ema", "var", "low", "high", "total")
#: So many rows of a series are run side by side with those of other series; windows are laid out for so many rows at a time.
ABREAST, LAID = 256, 100_000
COLUMNS = ("ma", "ema", "vol", "low", "high", "total", "mean", "std", "window_low", "window_high", "window_n", "corr")


def _decayed(x: np.ndarray, alpha: float, before: float | None) -> np.ndarray:
    """Recursive mean of x, after ``before`` or seeded by the first value."""
    seeded = x if before is None else np.concatenate([[before], x])
    return pd.Series(seeded).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(seeded) - len(x) :]


def begun(k: int, window: int) -> dict[str, np.ndarray]:
    """The states of k series before their first row, as arrays; ``xs`` and ``ys`` end with the latest, NaN before what they hold."""
    start = {"n": 0, "ma": 0.0, "ema": 0.0, "var": 0.0, "low": math.inf, "high": -math.inf, "total": 0.0, "nx": 0, "ny": 0}
    return {c: np.full(k, v) for c, v in start.items()} | {c: np.full((k, window), np.nan) for c in ("xs", "ys")}


def put(held: dict[str, np.ndarray], at: int, state: dict) -> None:
    """Sets series ``at`` of ``held`` to a state."""
    for c in SINGLE:
        held[c][at] = state[c]
    for c, size in (("xs", "nx"), ("ys", "ny")):
        last = list(state[c])[-held[c].shape[1] :]
        held[c][at, held[c].shape[1] - len(last) :] = last
        held[size][at] = len(last)


def get(held: dict[str, np.ndarray], at: int) -> dict:
    series = lambda c, size: held[c][at, held[c].shape[1] - held[size][at] :].tolist()
    return {c: held[c][at].item() for c in SINGLE} | {"xs": series("xs", "nx"), "ys": series("ys", "ny")}


def _recursed(values: np.ndarray, gains: np.ndarray, before: np.ndarray, first: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """s + gain (value - s) along each series (of ``size`` rows from ``first`` on), from ``before``; gains are constant after ``least`` rows.

    All series take a step at once; what is left of long ones is run alone.
    """
    out, abreast = np.empty_like(values), max(ABREAST, least)
    order = np.argsort(-size, kind="stable")
    first, size, s = first[order], size[order], before[:, order]
    for t in range(min(int(size.max(initial=0)), abreast)):
        k = int(np.searchsorted(-size, -t))  # series with more than t rows
        at = first[:k] + t
        s = (1 - gains[:, at]) * s[:, :k] + gains[:, at] * values[:, at]
        out[:, at] = s
    for a, n in zip(first[size > abreast], size[size > abreast], strict=True):
        for row, x, g in zip(out, values, gains, strict=True):
            row[a + abreast : a + n] = _decayed(x[a + abreast : a + n], g[a + n - 1], row[a + abreast - 1])
    return out


def _last(x: np.ndarray, series: np.ndarray, place: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The last values of its series at each of x, as many as ``before`` holds of what came before; NaN where there are fewer."""
    window = before.shape[1]
    out = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(window - 1, np.nan), x]), window).copy()
    early = np.flatnonzero(place < window - 1)
    at = place[early, None] + np.arange(1 - window, 1)
    out[early] = np.where(at >= 0, out[early], before[series[early, None], np.where(at < 0, window + at, 0)])
    return out


def fold(rows: pd.DataFrame, state: dict, paired: bool, window: int, span: float) -> pd.DataFrame:
    """Adds the running values of ``x`` (and ``y``) to rows in order and moves ``state`` on.

    ma: the mean until ``window`` values, then m + (x - m) / window. ema: seeded by the first value. vol: root of the
    decayed mean square. low, high, total: so far. mean, std (population), window_low, window_high, window_n: of the last
    ``window`` values. corr: of the last values of x and y, 0 for fewer than two or without variance.
    """
    x = rows["x"].to_numpy(float)
    y = rows["y"].to_numpy(float) if paired else None
    held = begun(1, window)
    put(held, 0, state)
    parts = [slice(a, a + LAID) for a in range(0, len(rows), LAID)]
    out = [fold_all(x[p], y[p] if paired else None, np.zeros(len(x[p]), int), held, window, span) for p in parts]
    state |= get(held, 0)
    return pd.concat([rows.reset_index(drop=True), pd.DataFrame(np.concatenate([np.empty((0, len(COLUMNS))), *out]), columns=list(COLUMNS))], axis=1)


def fold_all(every: np.ndarray, other: np.ndarray | None, numbers: np.ndarray, held: dict[str, np.ndarray], window: int, span: float) -> np.ndarray:
    """``fold`` for rows of many series, one after the other: ``numbers`` says, in order, which of the states in ``held`` a row is folded into."""
    out = np.full((len(every), len(COLUMNS)), np.nan)
    known = ~np.isnan(every)
    x, series = every[known], numbers[known]
    if not len(x):
        return out
    first = np.flatnonzero(np.diff(series, prepend=-1))
    size = np.diff(first, append=len(x))
    at, end = series[first], first + size - 1
    place = np.arange(len(x)) - np.repeat(first, size)
    n = held["n"][series] + place + 1
    full = np.minimum(n, window)
    decay = np.where(n == 1, 1.0, 2 / (span + 1))
    ma, ema, var = _recursed(np.stack([x, x, x * x]), np.stack([1 / full, decay, decay]), np.stack([held[c][at] for c in ("ma", "ema", "var")]), first, size, window)
    each = pd.Series(x).groupby(series)
    low, high = np.minimum(each.cummin().to_numpy(), held["low"][series]), np.maximum(each.cummax().to_numpy(), held["high"][series])
    total = held["total"][series] + each.cumsum().to_numpy()
    last = _last(x, series, place, held["xs"])
    mean = np.nansum(last, axis=1) / full
    std = np.sqrt(np.nansum((last - mean[:, None]) ** 2, axis=1) / full)
    corr = np.zeros(len(x))
    if other is not None:
        pair = _last(other[known], series, place, held["ys"])
        mid = np.nansum(pair, axis=1) / full
        both = std * np.sqrt(np.nansum((pair - mid[:, None]) ** 2, axis=1) / full)
        cov = np.nansum((last - mean[:, None]) * (pair - mid[:, None]), axis=1) / full
        np.divide(cov, both, out=corr, where=(full > 1) & (both > 0))
        corr[np.isnan(pair).sum(axis=1) > window - full] = np.nan
        held["ys"][at], held["ny"][at] = pair[end], np.minimum(held["ny"][at] + size, window)
    for c, v in (("n", n), ("ma", ma), ("ema", ema), ("var", var), ("low", low), ("high", high), ("total", total), ("xs", last)):
        held[c][at] = v[end]
    held["nx"][at] = np.minimum(held["nx"][at] + size, window)
    out[known] = np.stack([ma, ema, np.sqrt(var), low, high, total, mean, std, np.fmin.reduce(last, axis=1), np.fmax.reduce(last, axis=1), full.astype(float), corr], axis=1)
    return out


def folded(data: DataFrame, paired: bool, window: int, span: float, states: DataFrame | None = None, last: bool = False) -> DataFrame:
    """Rows (key, time, x, y and, where there are resets, reset) of a batch with their running values; with ``last``, each key's state after them.

    Spark brings a key's rows together in order of time, its row of ``states`` before them. A task folds the rows of all
    its keys batch by batch and carries on the state of the key that a batch ends in, so neither many short series nor
    one long one cost more than their rows. A row that resets begins anew, itself included.
    """
    seeded = states is not None
    if seeded:
        data = data.unionByName(states.select(F.col("key").cast(data.schema["key"].dataType).alias("key"), F.struct(*fresh()).alias("__held")), allowMissingColumns=True)
        order = [F.col("__held").isNull(), F.asc_nulls_last("time")]
    else:
        order = [F.asc_nulls_last("time")]
    rows = data.withColumn("__first", F.row_number().over(Window.partitionBy("key").orderBy(*order)) == 1)
    names = [c for c in data.columns if c not in ("reset", "__held")]
    schema = T.StructType([data.schema["key"], *T._parse_datatype_string(STATE).fields] if last else [*(data.schema[c] for c in names), *(T.StructField(c, T.DoubleType()) for c in COLUMNS)])

    def state_rows(key: pa.Array, held: dict[str, np.ndarray], at: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(held[c][at]) for c in SINGLE]
        for c, size in (("xs", "nx"), ("ys", "ny")):
            kept = np.arange(window) >= window - held[size][at][:, None]
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held[size][at])]), pa.int32()), pa.array(held[c][at][kept])))
        return pa.RecordBatch.from_arrays([key, *cols], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, key = begun(1, window), None
        for batch in (b.slice(a, LAID) for b in batches for a in range(0, b.num_rows, LAID)):
            get_ = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            first = get_("__first").astype(bool)
            begins = first | get_("reset").astype(bool) if "reset" in batch.schema.names else first
            numbers = np.cumsum(begins)  # 0: what the batch before ended in
            held = begun(int(numbers[-1]) + 1, window)
            for c, v in carried.items():
                held[c][:1] = v
            told = np.zeros(len(first), bool)
            if seeded:
                told = batch.column("__held").is_valid().to_numpy(zero_copy_only=False)
                for i, state in zip(np.flatnonzero(told & first), batch.column("__held").filter(pa.array(told & first)).to_pylist(), strict=True):
                    put(held, numbers[i], {c: [math.nan if v is None else v for v in x] if isinstance(x, list) else x for c, x in state.items()})
            x = get_("x").astype(float)
            out = fold_all(x, get_("y").astype(float) if paired else None, numbers, held, window, span)
            if last:
                ended = np.flatnonzero(first) if key is not None else np.flatnonzero(first)[1:]
                keys = pa.concat_arrays([batch.column("key")[:1] if key is None else key, batch.column("key")])  # a place late
                yield state_rows(keys.take(pa.array(ended)), held, numbers[ended] - 1)
            else:
                cols = [pa.array(get_(c).astype(float), from_pandas=True) if c in ("x", "y") else batch.column(c) for c in names]
                got = pa.RecordBatch.from_arrays([*cols, *(pa.array(v, from_pandas=True) for v in out.T)], names=schema.names)
                yield got.filter(pa.array(~told)) if told.any() else got
            carried, key = {c: v[-1:] for c, v in held.items()}, batch.column("key")[-1:]
        if last and key is not None:
            yield state_rows(key, carried, np.zeros(1, int))

    return rows.mapInArrow(run, schema)


def fresh() -> dict:
    return {"n": 0, "ma": 0.0, "ema": 0.0, "var": 0.0, "low": math.inf, "high": -math.inf, "total": 0.0, "xs": [], "ys": []}


def running(df: DataFrame, key: str, time: str, x: str, y: str | None = None, window: int = 20, span: float = 12) -> DataFrame:
    """``key, time, x[, y]`` with the running values; a stream keeps them in state, a batch starts from nothing.

    x and y may be the same column. Where y is missing, so are correlations over it; where x is, all values of the row.
    """
    named = {"key": key, "time": time, "x": x} | ({"y": y} if y else {})
    data = df.select(*[F.col(c).cast("double").alias(n) if n in "xy" else F.col(c).alias(n) for n, c in named.items()])
    schema = T.StructType([*data.schema.fields, *(T.StructField(c, T.DoubleType()) for c in COLUMNS)])
    out = list(dict.fromkeys(named.values()))
    back = [F.col(next(n for n, c in named.items() if c == o)).cast(df.schema[o].dataType).alias(o) for o in out]

    if not df.isStreaming:
        return folded(data, bool(y), window, span).select(*back, *COLUMNS)

    def step(_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = fresh()
        if state.exists:
            held = dict(zip(fresh(), state.get, strict=True))
            held["xs"], held["ys"] = list(held["xs"]), list(held["ys"])
        rows = pd.concat(list(batches)).sort_values("time", kind="stable")
        out = fold(rows, held, bool(y), window, span)
        state.update(tuple(held.values()))
        yield out

    got = data.groupBy("key").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)
    return got.select(*back, *COLUMNS)


def windowed(df: DataFrame, time: str, by: str, value: str, size: str = "1 day", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Count, sum, least and largest per window (tumbling, or sliding by ``slide``) and key; ``late`` is the watermark."""
    d = df.withColumn(time, F.col(time).cast("timestamp"))
    d = d.withWatermark(time, late) if late and df.isStreaming else d
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = d.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total", "low", "high")


def sessions(df: DataFrame, time: str, by: str, value: str, gap: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    d = df.withColumn(time, F.col(time).cast("timestamp"))
    d = d.withWatermark(time, late) if late and df.isStreaming else d
    out = d.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")
