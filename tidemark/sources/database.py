"""Parallel scans of a database table by ranges that are found, not given.

Counts by ranges of a column come from the database, a histogram of equal widths at first; what holds too many rows is
counted again in finer ranges, so that a skewed column gives even partitions. The scan itself is one query for each
range. The ranges reach from minus to plus infinity and have one for NULL, so no row is left out or read twice, however
rough the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges of a histogram, how often one is made finer, and ranges at most.
BINS, ROUNDS, MOST = 64, 12, 10_000


def _ask(spark: SparkSession, url: str, query: str, options: dict) -> list:
    return spark.read.format("jdbc").option("url", url).options(**options).option("query", query).load().collect()


def found_ranges(spark: SparkSession, url: str, query: str, column: str, rows: int = 1_000_000, **options: str) -> list[tuple[float | None, float | None, int]]:
    """(from, up to, rows) of consecutive ranges of a numeric column or expression, about ``rows`` each where its values allow."""
    low, high, n = _ask(spark, url, f"SELECT MIN({column}) AS a, MAX({column}) AS b, COUNT({column}) AS n FROM ({query}) q", options)[0]
    if not n:
        return [(None, None, 0)]
    rows = max(rows, n // MOST)
    low, high = float(low), float(high)
    open_, closed = [(low, high, int(n))], []
    whole = all(v == int(v) and abs(v) < 2**53 for v in (low, high))
    for _ in range(ROUNDS):
        again = []
        for a, b, count in open_:
            width = (b - a) / BINS if not whole else max(1.0, (b - a + 1) // BINS)
            if count <= rows or b <= a or width <= 0 or a + width == a:
                closed.append((a, count))
                continue
            last = "<=" if b == high else "<"
            at = f"FLOOR(CAST({column} - {a!r} AS DOUBLE) / {width!r})"
            got = _ask(spark, url, f"SELECT k, COUNT(*) AS n FROM (SELECT {at} AS k FROM ({query}) q WHERE {column} >= {a!r} AND {column} {last} {b!r}) h GROUP BY k", options)
            for k, c in sorted((int(r[0]), int(r[1])) for r in got):
                again.append((a + k * width, min(b, a + (k + 1) * width), c))
        open_ = again
        if not open_:
            break
    closed = sorted(closed + [(a, c) for a, _, c in open_])
    merged: list[list] = []
    for a, c in closed:  # small neighbours together
        if merged and merged[-1][1] + c <= rows:
            merged[-1][1] += c
        else:
            merged.append([a, c])
    ends = [None, *[a for a, _ in merged[1:]], None]
    return [(ends[i], ends[i + 1], c) for i, (_, c) in enumerate(merged)]


def scan(spark: SparkSession, url: str, query: str, column: str, rows: int = 1_000_000, also: str | None = None, **options: str) -> DataFrame:
    """A database query, read in ranges of ``column`` (a numeric column or expression of its own SQL).

    Where one value has more than ``rows`` rows, ``also``, a whole-number column or expression that isn't negative, deals
    them into several. Credentials and the driver come as options.
    """
    parts = []
    for a, b, n in found_ranges(spark, url, query, column, rows, **options):
        where = " AND ".join([*([f"{column} >= {a!r}"] if a is not None else []), *([f"{column} < {b!r}"] if b is not None else [])]) or f"{column} IS NOT NULL"
        deal = -(-n // rows) if also else 1
        parts += [f"{where} AND MOD({also}, {deal}) = {i}" for i in range(deal)] if deal > 1 else [where]
        parts += [f"{where} AND {also} IS NULL"] if deal > 1 else []
    return spark.read.jdbc(url, f"({query}) q", predicates=[*parts, f"{column} IS NULL"], properties=options)


def catalog(spark: SparkSession, url: str, tables: list[str], **options: str) -> DataFrame:
    """(table_name, column_name, type, rows) of the named tables."""
    out = []
    for t in tables:
        n = int(_ask(spark, url, f"SELECT COUNT(*) AS n FROM {t}", options)[0][0])
        schema = spark.read.format("jdbc").option("url", url).options(**options).option("query", f"SELECT * FROM {t}").load().schema
        out += [(t, f.name, f.dataType.simpleString(), n) for f in schema.fields]
    return spark.createDataFrame(out, "table_name string, column_name string, type string, rows long").orderBy("table_name", F.monotonically_increasing_id())
