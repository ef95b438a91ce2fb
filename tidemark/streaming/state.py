"""Running values in event-time order, and their state as a table: seeded from, listed, reset, moved to another stream.

``ordered`` keeps rows that may still be overtaken in the state store, and releases them by a timer once the watermark
has passed them, in order of time; so micro-batches in any order give what one sorted batch gives. A state is a row (the
key and the figures of ``incremental.STATE``): ``states_of`` makes it from a batch, ``stored`` reads it from a stream's
checkpoint, and both ``ordered`` and ``continued`` start from such a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .incremental import COLUMNS, STATE, fold, folded, fresh

NAMES = list(fresh())
PENDING = "time timestamp, x double, y double, reset boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _data(df: DataFrame, key: str, time: str, x: str, y: str | None, reset: str | None) -> DataFrame:
    flag = F.coalesce(F.col(reset).cast("boolean"), F.lit(False)) if reset else F.lit(False)
    return df.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(x).cast("double").alias("x"), (F.col(y).cast("double") if y else F.lit(None).cast("double")).alias("y"), flag.alias("reset"))


def _out(data: DataFrame) -> T.StructType:
    return T.StructType([*data.schema.fields[:-1], *(T.StructField(c, T.DoubleType()) for c in COLUMNS)])


def _keyed(states: DataFrame | None) -> DataFrame | None:
    return None if states is None else states.select(F.col(states.columns[0]).alias("key"), *NAMES)


def _named(out: DataFrame, df: DataFrame, key: str, time: str, x: str, y: str | None) -> DataFrame:
    back = {key: "key", time: "time", x: "x"} | ({y: "y"} if y else {})
    return out.select(*[F.col(n).cast(df.schema[c].dataType).alias(c) for c, n in back.items()], *COLUMNS)


def _held(values) -> dict:
    """A state from a row of its table."""
    held = dict(zip(NAMES, values, strict=True))
    return held | {"n": int(held["n"])} | {c: [float(v) for v in held[c]] for c in ("xs", "ys")}


def _values(held: dict) -> tuple:
    return tuple(list(map(float, v)) if k in ("xs", "ys") else int(v) if k == "n" else float(v) for k, v in held.items())


def _folded(rows: pd.DataFrame, held: dict, paired: bool, window: int, span: float) -> pd.DataFrame:
    """``rows`` in order; a row that resets begins anew, itself included."""
    rows = rows.sort_values("time", kind="stable")
    cuts = sorted({0, *np.flatnonzero(rows["reset"].to_numpy(bool)).tolist(), len(rows)})
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if rows["reset"].iloc[a]:
            held |= fresh()
        parts.append(fold(rows.iloc[a:b].drop(columns="reset"), held, paired, window, span))
    return pd.concat(parts)


def continued(df: DataFrame, key: str, time: str, x: str, y: str | None = None, before: DataFrame | None = None, reset: str | None = None, window: int = 20, span: float = 12) -> DataFrame:
    """A batch's running values, starting from the states in ``before`` (key and figures) where it has the key's."""
    return _named(folded(_data(df, key, time, x, y, reset), bool(y), window, span, _keyed(before)), df, key, time, x, y)


def states_of(df: DataFrame, key: str, time: str, x: str, y: str | None = None, before: DataFrame | None = None, reset: str | None = None, window: int = 20, span: float = 12) -> DataFrame:
    """(key, figures): the state of each key after its rows, and after ``before``; keys without rows keep theirs."""
    return folded(_data(df, key, time, x, y, reset), bool(y), window, span, _keyed(before), last=True).withColumnRenamed("key", key)


class Ordered(StatefulProcessor):
    """One key's rows: those that wait, and the state that the released ones have left."""

    def __init__(self, paired: bool, window: int, span: float, names: list[str]):
        self.paired, self.window, self.span, self.names = paired, window, span, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", STATE)
        self.pending = handle.getListState("pending", PENDING)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.running.update(_values(_held(initialState[NAMES].iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))[["time", "x", "y", "reset"]]
        self._wait([self._row(r) for r in new.itertuples(index=False)], append=True)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        rows = pd.DataFrame([tuple(r) for r in self.pending.get()], columns=["time", "x", "y", "reset"])
        rows["time"] = pd.to_datetime(rows["time"])
        ready = rows["time"] <= passed
        self.pending.clear()
        self._wait([self._row(r) for r in rows[~ready].itertuples(index=False)], append=False)
        if not ready.any():
            return
        held = _held(self.running.get()) if self.running.exists() else fresh()
        rows = rows[ready].astype({"x": float, "y": float, "reset": bool})
        out = _folded(rows, held, self.paired, self.window, self.span)
        self.running.update(_values(held))
        yield out.assign(key=key[0])[self.names]

    def close(self) -> None:
        pass

    @staticmethod
    def _row(r) -> tuple:
        number = lambda v: None if v is None or v != v else float(v)
        return pd.Timestamp(r.time).to_pydatetime(), number(r.x), number(r.y), bool(r.reset)

    def _wait(self, rows: list[tuple], append: bool) -> None:
        """Keep rows, with a timer at the first of them."""
        if rows:
            (self.pending.appendList if append else self.pending.put)(rows)
            first = min(r[0] for r in rows)
            self.handle.registerTimer(int(np.ceil(pd.Timestamp(first).value / 1e6)))


def ordered(stream: DataFrame, key: str, time: str, x: str, y: str | None = None, before: DataFrame | None = None, reset: str | None = None, late: str = "1 hour", window: int = 20, span: float = 12) -> DataFrame:
    """A stream's running values in order of ``time``, each row once the watermark (``late`` behind the latest) has passed it.

    ``before``: states that the keys start from. A row for which ``reset`` is true starts its key anew. Rows later than
    the watermark are left out by Spark. A key keeps the rows of the last ``late`` in the state store. The session needs
    the state store of RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    data = _data(stream, key, time, x, y, reset).withWatermark("time", late)
    schema = _out(data)
    initial = None if before is None else _keyed(before).groupBy("key")
    out = data.groupBy("key").transformWithStateInPandas(Ordered(bool(y), window, span, schema.names), schema, "Append", "EventTime", initial)
    return _named(out, stream, key, time, x, y)


def stored(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, figures) of all keys at the last batch of a stream of ``ordered``."""
    rows = spark.read.format("statestore").option("stateVarName", "running").load(checkpoint)
    return rows.select("key.*", "value.*")


def described(states: DataFrame) -> DataFrame:
    """(key, name, kind, length, value): what a table of states holds, figure by figure."""
    key = states.columns[0]
    number = lambda c: F.struct(F.lit(c).alias("name"), F.lit("numeric").alias("kind"), F.lit(None).cast("int").alias("length"), F.col(c).cast("double").alias("value"))
    series = lambda c: F.struct(F.lit(c).alias("name"), F.lit("rolling_window").alias("kind"), F.size(c).alias("length"), F.lit(None).cast("double").alias("value"))
    return states.select(key, F.explode(F.array(*[series(c) if c in ("xs", "ys") else number(c) for c in NAMES])).alias("f")).select(key, "f.*")
