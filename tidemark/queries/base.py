"""Registry, fixtures derived from the driver's tables, and small SQL builders for the oracle side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panel import Panel
from ..operators.price import Bar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
P = Panel(("secu",), ("d",))
B = Bar("o", "h", "l", "c", "v")
#: A total order of line items, unique in the tables.
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


#: Values are moved by so much before they are rounded, on both sides, or sums that differ in their last bit would
#: fall to different sides of a half.
NUDGE = 1.00000000001


def _calls(sql: str, name: str, make: Callable[[list[str]], str]) -> str:
    """``sql`` with each call of a function replaced, inner ones first."""
    out, at = "", 0
    for m in re.finditer(rf"\b{name}\(", sql):
        if m.start() < at:
            continue
        depth, k, args, start = 1, m.end(), [], m.end()
        while depth:
            c = sql[k]
            depth += (c in "([") - (c in ")]")
            if depth == 0 or depth == 1 and c == ",":
                args.append(sql[start:k])
                start = k + 1
            k += 1
        out += sql[at : m.start()] + make([_calls(a.strip(), name, make) for a in args])
        at = k
    return out + sql[at:]


def _portable(sql: str) -> str:
    """Rounding with the nudge; counts of conditions as BIGINT."""
    sql = _calls(sql, "round", lambda a: f"round(({a[0]}) * {NUDGE!r}, {a[1]})")
    return _calls(sql, "count_if", lambda a: f"count(CASE WHEN {a[0]} THEN 1 END)")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = _portable(sql)
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles to ``digits`` places (or their own), negative zero as zero."""
    cut = lambda f: (F.round(F.col(f.name) * NUDGE, own.get(f.name, digits)) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
    return df.select(*[cut(f) for f in df.schema.fields])


def _bars(spark: SparkSession, sf_dir: str, key: str, day) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    if key == "n_regionkey":
        li = li.join(read(spark, sf_dir, "supplier"), li.l_suppkey == F.col("s_suppkey")).join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    px, at = F.col("l_extendedprice") / F.col("l_quantity"), F.struct(*ORDER)
    rows = li.select(F.col(key).alias("secu"), day.alias("d"), px.alias("px"), at.alias("at"), "l_quantity", "l_extendedprice")
    return rows.groupBy("secu", "d").agg(F.min_by("px", "at").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", "at").alias("c"), F.sum("l_quantity").alias("v"), F.sum("l_extendedprice").alias("amt"), F.count("*").alias("n"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each region: (secu, d, o, h, l, c, v, amt, n)."""
    return _bars(spark, sf_dir, "n_regionkey", F.col("l_shipdate").cast("date"))


def month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of each supplier."""
    return _bars(spark, sf_dir, "l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "month"))


def flag_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each return flag."""
    return _bars(spark, sf_dir, "l_returnflag", F.col("l_shipdate").cast("date"))


def _bars_sql(key: str, day: str, source: str) -> str:
    order = ", ".join(ORDER)
    return f"""b AS (SELECT secu, d, first(px ORDER BY {order}) AS o, max(px) AS h, min(px) AS l, last(px ORDER BY {order}) AS c,
      sum(l_quantity) AS v, sum(l_extendedprice) AS amt, count(*) AS n
    FROM (SELECT {key} AS secu, {day} AS d, l_extendedprice / l_quantity AS px, * FROM {source}) GROUP BY secu, d)"""


DAY = "CAST(l_shipdate AS DATE)"
BARS = _bars_sql("n_regionkey", DAY, "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
MONTH_BARS = _bars_sql("l_suppkey", "CAST(date_trunc('month', l_shipdate) AS DATE)", "lineitem")
FLAG_BARS = _bars_sql("l_returnflag", DAY, "lineitem")
W = "(PARTITION BY secu ORDER BY d)"


def R(n: int) -> str:
    return f"(PARTITION BY secu ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {R(n)} = {n} THEN {agg}({x}) OVER {R(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {W}"


def pct(x: str, n: int = 1) -> str:
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def corr(x: str, y: str, n: int) -> str:
    a, b, r = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)", R(n)
    return f"CASE WHEN count({a}) OVER {r} = {n} THEN covar_samp({a}, {b}) OVER {r} / nullif(stddev_samp({a}) OVER {r} * stddev_samp({b}) OVER {r}, 0) END"


def log(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"


def steps(*made: dict[str, str], out: list[str], keys: str = "secu, d", source: str = BARS, digits: int = 6, exact: tuple[str, ...] = (), own: dict[str, int] | None = None, where: str = "") -> str:
    """Each step adds columns to the one before; the last selects ``out``, rounded unless ``exact``."""
    text, at = f"WITH {source}", "b"
    for i, new in enumerate(made):
        text += f", s{i} AS (SELECT *, " + ", ".join(f'{e} AS "{k}"' for k, e in new.items()) + f" FROM {at})"
        at = f"s{i}"
    cols = ", ".join(f'"{k}"' if k in exact else f'round("{k}", {(own or {}).get(k, digits)}) + 0.0 AS "{k}"' for k in out)
    return f"{text} SELECT {keys}, {cols} FROM {at} {where}"
