"""python -m tidemark.plans.flows {report,drift,sql} ...: the flows beside feature building (tidemark.plans.cli).

report INPUT OUTPUT    a table's summary, its numeric columns' statistics and their correlations
drift REF CUR OUTPUT   each column's drift, that of their principal components, and which columns drifted most
sql QUERY OUTPUT       a query over files (--table NAME=PATH) or over a database (--url URL), written as a table
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panel import Panel
from ..operators import clean, drift, research
from ..sources.tables import read, read_jdbc, write
from .pipeline import feature_report, report


def reported(df: DataFrame, p: Panel, columns: Sequence[str] = (), target: str | None = None) -> dict[str, DataFrame]:
    """``summary``, ``features`` and ``correlations`` of a table; the columns are all numeric ones by default."""
    names = [c for c in columns or clean.numeric(df) if c not in (*p.by, *p.time, target)]
    out = {"summary": report(df, p)}
    if names:
        out["features"] = feature_report(df, names, target)
    if len(names) > 1:
        out["correlations"] = research.correlations(df.select(*names), names)
    return out


def drifted(ref: DataFrame, cur: DataFrame, columns: Sequence[str] = (), method: str = "ks", components: int = 3) -> dict[str, DataFrame]:
    """``features``, ``components`` (with two columns or more) and ``most`` of the numeric columns that both tables have."""
    names = list(columns) or [c for c in clean.numeric(ref) if c in clean.numeric(cur)]
    if not names:
        raise ValueError("no numeric columns in common")
    found = {"ks": drift.ks, "wasserstein": drift.wasserstein}[method](ref, cur, names)
    out = {"features": found, "most": drift.most_drifted(found.where("drifted"))}
    if len(names) > 1:
        out["components"] = drift.covariate(ref.dropna(subset=names), cur.dropna(subset=names), names, components)
    return out


def queried(spark: SparkSession, sql: str, tables: dict[str, str] | None = None, url: str | None = None, **options: str) -> DataFrame:
    """The query's rows, from a database if a URL is given, else from files under the names given to them."""
    if url is not None:
        return read_jdbc(spark, url, sql, **options)
    return spark.sql(sql, **{name: read(spark, path) for name, path in (tables or {}).items()})


def main(args: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    flow = a.add_subparsers(dest="flow", required=True)
    one = flow.add_parser("report")
    one.add_argument("input")
    one.add_argument("--key", default="SecuCode")
    one.add_argument("--time", default="TradingDay")
    one.add_argument("--target")
    two = flow.add_parser("drift")
    two.add_argument("reference")
    two.add_argument("current")
    two.add_argument("--method", default="ks", choices=["ks", "wasserstein"])
    three = flow.add_parser("sql")
    three.add_argument("query")
    three.add_argument("--table", nargs="*", default=[], metavar="NAME=PATH", help="written {NAME} in the query")
    three.add_argument("--url")
    for f in (one, two, three):
        f.add_argument("output")
        f.add_argument("--columns", nargs="*", default=[])
        f.add_argument("--format", default="parquet")
    o = a.parse_args(args)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if o.flow == "report":
        made = reported(read(spark, o.input), Panel((o.key,), (o.time,)), o.columns, o.target)
    elif o.flow == "drift":
        made = drifted(read(spark, o.reference), read(spark, o.current), o.columns, o.method)
    else:
        df = queried(spark, o.query, dict(t.split("=", 1) for t in o.table), o.url)
        write(df.select(*[F.col(f"`{c}`") for c in o.columns]) if o.columns else df, o.output, o.format)
        return 0
    for name, df in made.items():
        write(df, f"{o.output}/{name}", o.format)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
