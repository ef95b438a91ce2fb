"""Scans by found ranges over an in-process database; the wide table without exchanges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import database, wide

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def url(spark):
    url = "jdbc:derby:memory:scans;create=true"
    rng = np.random.default_rng(1)
    k = [int(v) for v in np.concatenate([rng.integers(0, 50, 3000), 10**9 + rng.integers(0, 1000, 1500), np.full(2500, 77), [-(10**12)]])]
    rows = [(v, float(v) / 7, i) for i, v in enumerate(k)] + [(None, None, 10_000 + i) for i in range(40)]
    spark.createDataFrame(rows, "K long, X double, I int").coalesce(1).write.jdbc(url, "T", "overwrite", {"driver": DRIVER})
    spark.createDataFrame([], "K long, V int").write.jdbc(url, "E", "overwrite", {"driver": DRIVER})
    return url


def test_even_ranges_of_a_skewed_column(spark, url):
    got = database.found_ranges(spark, url, "SELECT * FROM T", "K", 500, driver=DRIVER)
    assert sum(n for *_, n in got) == 7001 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert got[0][0] is None and got[-1][1] is None
    sizes = sorted(n for *_, n in got)
    assert sizes[-1] <= 2500 + 500 and sizes[-2] <= 500  # one value alone has 2,500 rows
    for column in ("K", "X"):
        df = database.scan(spark, url, "SELECT * FROM T", column, 500, driver=DRIVER)
        assert sorted(r.I for r in df.collect()) == [*range(7001), *range(10_000, 10_040)]
    parts = database.scan(spark, url, "SELECT * FROM T", "K", 500, also="I", driver=DRIVER).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 7041 and max(r["count"] for r in parts) <= 600


def test_small_tables_and_catalog(spark, url):
    assert database.found_ranges(spark, url, "SELECT * FROM E", "K", driver=DRIVER) == [(None, None, 0)]
    assert database.scan(spark, url, "SELECT * FROM E", "K", driver=DRIVER).count() == 0
    one = database.scan(spark, url, "SELECT * FROM T WHERE I < 10 OR K IS NULL", "K + I", driver=DRIVER)
    assert one.count() == 50
    told = [tuple(r) for r in database.catalog(spark, url, ["T", "E"], driver=DRIVER).collect()]
    assert ("T", "X", "double", 7041) in told and ("E", "V", "int", 0) in told and len(told) == 5


@pytest.fixture
def tables(spark, tmp_path):
    made = []

    def keep(df, name, **how):
        wide.keep(df, name, ["secu", "d"], 4, path=str(tmp_path / name), **how)
        made.append(name)

    yield keep
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def days(spark, n, value):
    return spark.range(n).select((F.col("id") % 9).alias("secu"), F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 9).cast("int")).alias("d"), F.expr(value).alias("v"))


def test_seven_tables_join_without_exchange(spark, tables):
    names = [f"wide_{i}" for i in range(7)]
    for i, name in enumerate(names):
        tables(days(spark, 500 - 30 * i, f"id * {i}").withColumnRenamed("v", f"v{i}"), name)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = wide.joined(spark, names, ["secu", "d"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 6
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(rows) == 500 and sum(r.v6 is not None for r in rows) == 320
    assert all(r.v3 is None or r.v3 * 2 == r.v6 or r.v6 is None for r in rows)


def test_a_month_is_rewritten_alone(spark, tables):
    tables(days(spark, 900, "id"), "by_month", day="d")
    old = {r.month: (r.n, r.s) for r in spark.table("by_month").groupBy("month").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    new = days(spark, 900, "-id").where("d >= '2024-02-01' AND d < '2024-03-01'")
    wide.replace_months(new, "by_month", "d")
    got = {r.month: (r.n, r.s) for r in spark.table("by_month").groupBy("month").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    assert len(old) == 4 and got == old | {"2024-02": (old["2024-02"][0], -old["2024-02"][1])}
    tables(days(spark, 900, "1"), "other")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spark.table("by_month").hint("merge").join(spark.table("other").withColumnRenamed("v", "w"), ["secu", "d"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in plan  # the rewritten files are bucketed too
