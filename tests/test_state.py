"""States as tables, and rows that come late."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import incremental, state

START = dt.datetime(2024, 1, 1)
DDL = "k string, t timestamp, x double, y double, again boolean"


def rows(n=240, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = "abc"[i % 3]
        out.append((k, START + dt.timedelta(minutes=7 * i), None if i % 31 == 5 else float(rng.normal()), float(rng.normal()), k == "b" and i // 3 == 40))
    return out


def same(got, want):
    a, b = ({(r.k, r.t): [getattr(r, c) for c in incremental.COLUMNS] for r in d} for d in (got, want))
    assert a.keys() == b.keys() and len(a) == len(got)
    for key, v in b.items():
        for c, p, q in zip(incremental.COLUMNS, a[key], v, strict=True):
            assert (p is None or p != p) == (q is None or q != q) and (q is None or q != q or abs(p - q) < 1e-9), (key, c, p, q)


def test_continued_from_a_table_of_states(spark):
    df = spark.createDataFrame(rows(), DDL)
    cut = START + dt.timedelta(minutes=7 * 100)
    first, second = df.where(F.col("t") < cut), df.where(F.col("t") >= cut)
    held = state.states_of(first, "k", "t", "x", "y")
    whole = incremental.running(df, "k", "t", "x", "y")
    same(state.continued(second, "k", "t", "x", "y", before=held).collect(), whole.where(F.col("t") >= cut).collect())
    a, b = ({r.k: r for r in d.collect()} for d in (state.states_of(second, "k", "t", "x", "y", before=held), state.states_of(df, "k", "t", "x", "y")))
    for k in "abc":
        assert a[k].n == b[k].n and np.allclose(a[k].xs, b[k].xs) and abs(a[k].ema - b[k].ema) < 1e-9
    same(state.continued(df, "k", "t", "x", "y").collect(), whole.collect())
    assert {r.k for r in state.states_of(df.limit(0), "k", "t", "x", before=held).collect()} == set("abc")
    told = {(r.k, r.name): r for r in state.described(held).collect()}
    assert told["a", "xs"].kind == "rolling_window" and told["a", "xs"].length == 20 and told["b", "n"].value == sum(r[0] == "b" and r[1] < cut and r[2] is not None for r in rows())


def test_reset(spark):
    df = spark.createDataFrame(rows(), DDL)
    at = START + dt.timedelta(minutes=7 * 121)
    got = state.continued(df, "k", "t", "x", reset="again").where("k = 'b'")
    after = incremental.running(df.where((F.col("k") == "b") & (F.col("t") >= at)), "k", "t", "x").collect()
    same(got.where(F.col("t") >= at).collect(), after)


def plain(x, window=20, span=12):
    """The running values of known x, one by one."""
    out, ma, ema, var, a = [], 0.0, None, None, 2 / (span + 1)
    for i, v in enumerate(x):
        ma += (v - ma) / min(i + 1, window)
        ema, var = (v, v * v) if i == 0 else (ema + a * (v - ema), var + a * (v * v - var))
        w = x[max(0, i + 1 - window) : i + 1]
        out.append((ma, ema, var**0.5, min(x[: i + 1]), max(x[: i + 1]), sum(x[: i + 1]), np.mean(w), np.std(w), min(w), max(w), len(w)))
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_many_keys_are_folded_together(spark, batch):
    """Keys that end within a batch of Spark's rows and ones that go on over many; none takes a call of its own."""
    rng = np.random.default_rng(5)
    sizes = {None: 9, 2**53 + 1: 4, **{k: int(rng.integers(1, 30)) for k in range(40)}, 77: 700}
    every = [(k, START + dt.timedelta(seconds=i), float(rng.normal()), None, bool(rng.random() < 0.1)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(every, DDL.replace("k string", "k long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        cut = START + dt.timedelta(seconds=6)
        held = state.states_of(df.where(F.col("t") < cut), "k", "t", "x", reset="again")
        resumed = state.continued(df.where(F.col("t") >= cut), "k", "t", "x", before=held, reset="again")
        whole = state.continued(df, "k", "t", "x", reset="again")
        for d in (held, resumed, whole, incremental.running(df, "k", "t", "x")):
            plan = d._jdf.queryExecution().executedPlan().toString()
            assert "GroupsInPandas" not in plan and "CoGroup" not in plan
        want, last = {}, {}
        for k, n in sizes.items():
            own = [r for r in every if r[0] == k]
            cuts = sorted({0, *(i for i, r in enumerate(own) if r[4]), n})
            for a, b in zip(cuts[:-1], cuts[1:]):
                want |= {(k, own[a + i][1]): v for i, v in enumerate(plain([r[2] for r in own[a:b]]))}
            first = own[:6]
            begin = max([0, *(i for i, r in enumerate(first) if r[4])])
            last[k] = [r[2] for r in first[begin:]]
        for got, since in ((whole.collect(), START), (resumed.collect(), cut)):
            assert {(r.k, r.t) for r in got} == {at for at in want if at[1] >= since} and len({(r.k, r.t) for r in got}) == len(got)
            for r in got:
                np.testing.assert_allclose([getattr(r, c) for c in incremental.COLUMNS[:-1]], want[r.k, r.t], rtol=1e-9, atol=1e-9)
        assert {r.k: (r.n, list(r.xs)) for r in held.collect()} == {k: (len(v), v) for k, v in last.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, batches, name, **how):
    """Each batch is a file, read in the order of their times; the last rows push the watermark past all."""
    import time

    source = folder / name
    for i, part in enumerate(batches):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.05)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = state.ordered(stream, "k", "t", "x", "y", **how).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return [r for r in spark.table(name).collect() if r.k != "~"]


def test_late_rows_and_moved_state(rocks, tmp_path):
    spark, every = rocks, rows()
    push = [("~", START + dt.timedelta(days=30), 1.0, 1.0, False)]
    rng, mixed = np.random.default_rng(3), list(every)
    for a in range(0, len(mixed), 40):  # rows overtake each other within some five hours, also over files
        part = mixed[a : a + 40]
        rng.shuffle(part)
        mixed[a : a + 40] = [tuple(r) for r in part]
    batches = [[r for r in mixed[a : a + 30]] for a in range(0, len(mixed), 30)]
    got = run(spark, tmp_path, [*batches, push], "late", late="6 hours")
    df = spark.createDataFrame(every, DDL)
    same(got, incremental.running(df, "k", "t", "x", "y").collect())

    held = state.stored(spark, str(tmp_path / "late-c")).where("key <> '~'")
    want = {r.k: r for r in state.states_of(df, "k", "t", "x", "y").collect()}
    assert {r[0]: r.n for r in held.collect()} == {k: r.n for k, r in want.items()}
    more = [(k, t + dt.timedelta(days=5), x, y, False) for k, t, x, y, _ in rows(60, 9)]
    table = spark.createDataFrame(held.collect(), held.schema)
    second = run(spark, tmp_path, [more[30:], more[:30], push], "moved", late="6 hours", before=table)
    through = incremental.running(spark.createDataFrame(every + more, DDL), "k", "t", "x", "y").where(F.col("t") >= F.lit(START + dt.timedelta(days=5)))
    same(second, through.collect())
