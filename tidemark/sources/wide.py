"""The wide table as a table: parts bucketed and sorted by one key, joined without an exchange, and rewritten month by month."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The partition column of a table that is kept by month.
MONTH = "month"


def keep(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None, day: str | None = None) -> None:
    """Write ``df`` as a table whose rows lie in ``buckets`` files by ``keys``, sorted by them; by month of ``day``, if given.

    Rows are dealt out by the keys first, so each bucket (of a month) is one file. A key's bucket takes all of its rows,
    so the keys together should be near unique.
    """
    if day:
        df = df.withColumn(MONTH, F.date_format(day, "yyyy-MM"))
    w = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    w = w.option("path", path) if path else w
    (w.partitionBy(MONTH) if day else w).saveAsTable(name)


def replace_months(df: DataFrame, name: str, day: str) -> None:
    """Write the months that ``df`` has anew, one by one; the table's other months stay as they are, and so do the session's settings."""
    spark = df.sparkSession
    spec = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    buckets, keys = int(spec["Num Buckets"]), [k.strip("` ") for k in spec["Bucket Columns"].strip("[]").split(",")]
    rows = df.withColumn(MONTH, F.date_format(day, "yyyy-MM"))
    columns = [c for c in spark.table(name).columns if c != MONTH]
    for r in rows.select(MONTH).distinct().orderBy(MONTH).collect():  # as many as there are months
        own = rows.where(F.col(MONTH) == r[MONTH]).select(*columns).repartition(buckets, *keys)
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({MONTH} = '{r[MONTH]}') SELECT * FROM {{own}}", own=own)


def joined(spark: SparkSession, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Left joins of the first table with the others by ``keys``: where all were kept by these in as many buckets, without an exchange."""
    tables = [spark.table(n) for n in names]
    return reduce(lambda a, b: a.join(b.hint("merge"), list(keys), "left"), tables)
