"""Reading and writing tables by format, path or strategy; everything goes through Spark's readers and writers."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("parquet", "csv", "json", "orc")


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A file or a folder, partitioned or not. The format is the path's ending, parquet for a folder; spreadsheet, HDF5 and feather files are refused."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        raise FileNotFoundError(path)
    ending = path.rstrip("/").rpartition(".")[2].lower()
    fmt = fmt or {"csv": "csv", "json": "json", "orc": "orc", "xlsx": "excel", "h5": "hdf5", "feather": "feather"}.get(ending, "parquet")
    if fmt in ("excel", "hdf5", "feather"):
        raise ValueError(f"{fmt} files can't be read in parallel; convert them to parquet first")
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
        reader = reader.option("inferSchema", "true") if schema is None else reader
    return (reader if schema is None else reader.schema(schema)).load(path)


def read_jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A database query, in parallel ranges of an integer column if one is named. Credentials come as options."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column is None:
        return reader.option("query", query).load()
    return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def write(df: DataFrame, path: str, fmt: str = "parquet", compression: str = "snappy", by: Sequence[str] = (), mode: str = "overwrite", rows_a_file: int | None = None) -> None:
    if fmt == "feather":
        fmt = "parquet"
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    w = df.write.mode(mode).format(fmt)
    w = w.option("header", "true") if fmt == "csv" else w
    w = w.option("compression", compression) if fmt in ("parquet", "orc") or compression == "gzip" else w
    w = w.option("maxRecordsPerFile", rows_a_file) if rows_a_file else w
    (w.partitionBy(*by) if by else w).save(path)


@dataclass(frozen=True)
class Strategy:
    """How a kind of table is stored."""

    fmt: str = "parquet"
    compression: str = "snappy"
    by: tuple[str, ...] = ()
    rows_a_file: int = 1_000_000
    sort: tuple[str, ...] = ()
    about: str = ""


STRATEGIES: dict[str, Strategy] = {
    "raw_data": Strategy(about="as delivered", rows_a_file=1_000_000),
    "feature_data": Strategy(by=("market_code",), about="wide features, read by column", rows_a_file=500_000),
    "timeseries_data": Strategy(by=("date", "market_code"), about="read by date range", rows_a_file=1_000_000),
    "processed_data": Strategy(compression="gzip", about="kept long, read seldom", rows_a_file=2_000_000),
    "temporary_data": Strategy(compression="lz4", about="written and read once", rows_a_file=1_000_000),
    "archive_data": Strategy(compression="zstd", about="smallest", rows_a_file=2_000_000),
}


def recommended(rows: int, access: str = "batch") -> str:
    """A strategy's name by size and by how the table is read."""
    if access == "timeseries":
        return "timeseries_data"
    if access == "feature":
        return "feature_data"
    return "temporary_data" if rows < 10_000 else "raw_data" if rows < 1_000_000 else "processed_data"


@dataclass
class Store:
    """Tables under a root, each written by a strategy with a side-car of what it holds."""

    spark: SparkSession
    root: str
    strategies: dict[str, Strategy] = field(default_factory=lambda: dict(STRATEGIES))

    def strategy(self, name: str) -> Strategy:
        return self.strategies.get(name, Strategy())

    def path(self, kind: str, name: str | None = None) -> str:
        return f"{self.root}/{kind}/{name or f'{kind}_{datetime.now():%Y%m%d_%H%M%S}'}"

    def save(self, df: DataFrame, kind: str, name: str | None = None) -> str:
        s, path = self.strategy(kind), self.path(kind, name)
        by = [c for c in s.by if c in df.columns]
        if by:  # rows of a partition come together, but in as many tasks as their size asks for
            df = df.hint("rebalance", *by)
        if s.sort:
            df = df.sortWithinPartitions(*by, *s.sort)
        write(df, path, s.fmt, s.compression, by, rows_a_file=s.rows_a_file)
        about = {"strategy": asdict(s), "columns": df.columns, "rows": self.load(kind, path.rpartition("/")[2]).count()}
        self.spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}.about")
        return path

    def load(self, kind: str, name: str) -> DataFrame:
        return read(self.spark, self.path(kind, name), self.strategy(kind).fmt)

    def about(self, kind: str, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path(kind, name)}.about").first()[0])

    def remove(self, kind: str, name: str) -> None:
        for path in (self.path(kind, name), f"{self.path(kind, name)}.about"):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


    def keep_strategies(self, path: str | None = None) -> str:
        """Writes all strategies as JSON lines, by default beside the tables, and says where."""
        path = path or f"{self.root}/_strategies"
        rows = [(json.dumps({"name": n} | asdict(s)),) for n, s in sorted(self.strategies.items())]
        self.spark.createDataFrame(rows, "line string").coalesce(1).write.mode("overwrite").text(path)
        return path

    def take_strategies(self, path: str | None = None) -> list[str]:
        """Adds the strategies that were written, over those of the same names; fields that are absent keep their defaults, unknown ones are an error."""
        names = []
        for (line,) in self.spark.read.text(path or f"{self.root}/_strategies").collect():  # a row for each strategy
            how = json.loads(line)
            names.append(how.pop("name"))
            self.strategies[names[-1]] = Strategy(**{k: tuple(v) if isinstance(v, list) else v for k, v in how.items()})
        return sorted(names)

    def files(self) -> DataFrame:
        """(kind, name, files, bytes, modified) of the tables, from the file system's listing; no file is opened."""
        fs, root = _fs(self.spark, self.root)
        rows = []
        for kind in _listed(fs, root):
            for t in _listed(fs, kind.getPath()) if kind.isDirectory() and not kind.getPath().getName().startswith("_") else []:
                if t.getPath().getName().endswith(".about"):
                    continue
                size = fs.getContentSummary(t.getPath())
                rows.append((kind.getPath().getName(), t.getPath().getName(), size.getFileCount(), size.getLength(), datetime.fromtimestamp(t.getModificationTime() / 1000)))
        return self.spark.createDataFrame(rows, "kind string, name string, files long, bytes long, modified timestamp")

    def info(self) -> DataFrame:
        """(kind, tables, files, bytes), and a row over all kinds, whose kind is NULL."""
        return self.files().rollup("kind").agg(F.count("*").alias("tables"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))

    def remove_older(self, kind: str = "temporary_data", days: float = 7.0) -> list[str]:
        """Removes the tables of a kind that were last written more than ``days`` days ago; their names."""
        old = self.files().where((F.col("kind") == kind) & (F.col("modified") < F.lit(datetime.now() - timedelta(days=days))))
        names = sorted(r["name"] for r in old.select("name").collect())
        for n in names:
            self.remove(kind, n)
        return names

    def back_up(self, kinds: Sequence[str] = ("raw_data", "feature_data", "processed_data"), name: str | None = None) -> str:
        """Tables of these kinds and what is said of them, written again under ``_backup/name`` by Spark; where that is."""
        to = Store(self.spark, f"{self.root}/_backup/{name or f'{datetime.now():%Y%m%d_%H%M%S}'}", self.strategies)
        for r in self.files().where(F.col("kind").isin(*kinds)).select("kind", "name").collect():  # a row for each table
            to.save(self.load(r["kind"], r["name"]), r["kind"], r["name"])
        return to.root


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(fs, path) -> list:
    return list(fs.listStatus(path)) if fs.exists(path) else []


#: What each format is for.
ABOUT_FORMATS = {
    "parquet": "columns with statistics: scans of few columns and filters read little",
    "orc": "as parquet, with indexes in the file",
    "csv": "text for exchange; no types, no statistics",
    "json": "text with nested fields; no statistics",
}


def format_info(spark: SparkSession) -> DataFrame:
    """(format, about, columnar) of the formats that can be read and written."""
    return spark.createDataFrame([(f, ABOUT_FORMATS[f], f in ("parquet", "orc")) for f in FORMATS], "format string, about string, columnar boolean")


def month_ranges(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(year, month, start, end) of each month from ``start`` to ``end``, the first and last clipped to these."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    first = spark.range(1).select(F.explode(F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month"))).alias("m")).where(lo <= hi)
    return first.select(F.year("m").alias("year"), F.month("m").alias("month"), F.greatest("m", lo).alias("start"), F.least(F.last_day("m"), hi).alias("end"))


def monthly(df: DataFrame, day: str) -> DataFrame:
    """``year`` and ``month`` for partitioned output."""
    return df.withColumns({"year": F.year(day), "month": F.month(day)})


def catalog(spark: SparkSession) -> DataFrame:
    """(name, columns, types) of the session's tables and views."""
    rows = [(t.name, [c.name for c in cols], [c.dataType for c in cols]) for t in spark.catalog.listTables() for cols in [spark.catalog.listColumns(t.name)]]
    return spark.createDataFrame(rows, "name string, columns array<string>, types array<string>")
