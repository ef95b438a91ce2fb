"""python -m tidemark.plans.cli INPUT OUTPUT [--groups price volume technical] [--key COLUMN] [--time COLUMN] [--report]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..functions.panel import Panel
from ..sources.tables import read, write
from .pipeline import GROUPS, FeaturePipeline, report


def main(args: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--groups", nargs="+", default=list(GROUPS), choices=list(GROUPS))
    a.add_argument("--key", default="SecuCode")
    a.add_argument("--time", default="TradingDay")
    a.add_argument("--format", default="parquet")
    a.add_argument("--report", action="store_true")
    o = a.parse_args(args)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    p = Panel((o.key,), (o.time,))
    df = read(spark, o.input)
    write(FeaturePipeline(p, o.groups).run(df), o.output, o.format)
    if o.report:
        report(df, p).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
