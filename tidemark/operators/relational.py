"""Quote history, listings and summaries over warehouse tables, and suspension records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE_KEYS = ["InnerCode", "TradingDay"]


def quote_history(quotes: DataFrame, limits: DataFrame, performance: DataFrame, securities: DataFrame, start: str, end: str, markets: Sequence[int] = (83, 90), with_suspended: bool = False) -> DataFrame:
    """Daily quotes with price limits, suspension flag and security data; listed main securities of the markets only."""
    q = quotes.where(F.col("TradingDay").between(start, end))
    s = securities.where((F.col("SecuCategory") == 1) & F.col("SecuMarket").isin(*markets) & (F.col("ListedState") == 1)).select("InnerCode", "SecuCode", "SecuMarket")
    out = q.join(limits, QUOTE_KEYS, "left").join(performance.select(*QUOTE_KEYS, "Ifsuspend"), QUOTE_KEYS, "left").join(s, "InnerCode")
    return out if with_suspended else out.where("Ifsuspend IS NULL OR Ifsuspend = 0")


def quotes_by_code(quotes: DataFrame, securities: DataFrame, codes: DataFrame, start: str, end: str) -> DataFrame:
    """Quotes of the codes in a one-column table (a semi-join, however many)."""
    s = securities.join(codes.select("SecuCode").distinct(), "SecuCode", "left_semi").select("InnerCode", "SecuCode")
    return quotes.where(F.col("TradingDay").between(start, end)).join(s, "InnerCode")


def stock_list(securities: DataFrame, markets: Sequence[int] = (83, 90)) -> DataFrame:
    return securities.where((F.col("SecuCategory") == 1) & F.col("SecuMarket").isin(*markets) & (F.col("ListedState") == 1)).orderBy("SecuCode")


def trading_dates(quotes: DataFrame, start: str, end: str) -> DataFrame:
    return quotes.where(F.col("TradingDay").between(start, end)).select("TradingDay").distinct()


def market_summary(quotes: DataFrame, market: str, code: str, volume: str, value: str, close: str) -> DataFrame:
    """Per market: distinct securities, volume, value, mean close."""
    return quotes.groupBy(market).agg(F.countDistinct(code).alias("stock_count"), F.sum(volume).alias("total_volume"), F.sum(value).alias("total_value"), F.avg(close).alias("avg_close"))


def decoded(code: str, names: dict[int, str]) -> Column:
    """The code's name, or unknown(code)."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(F.col(code).isNotNull(), F.coalesce(F.element_at(table, F.col(code)), F.concat(F.lit("unknown("), F.col(code).cast("string"), F.lit(")"))))


def named(df: DataFrame, code: str, constants: DataFrame, kind: int, name: str, kind_col: str = "LB", code_col: str = "DM", name_col: str = "MC") -> DataFrame:
    """``df`` with the name that a table of constants gives to the code of a kind, unknown(code) if it has none. Of two names of a code the lesser holds."""
    known = constants.where(F.col(kind_col) == kind).groupBy(F.col(code_col).alias("__code")).agg(F.min(name_col).alias("__name"))
    unknown = F.concat(F.lit("unknown("), F.col(code).cast("string"), F.lit(")"))
    return df.join(known, F.col(code) == F.col("__code"), "left").withColumn(name, F.coalesce("__name", unknown)).drop("__code", "__name")


def table_facts(df: DataFrame, time: str, key: str) -> DataFrame:
    """One row: number of records, first and last time, distinct keys."""
    return df.agg(F.count("*").alias("total_records"), F.min(time).alias("earliest_date"), F.max(time).alias("latest_date"), F.countDistinct(key).alias("unique_securities"))


def suspension_fields(df: DataFrame, as_of: Column, start: str = "SuspendDate", end: str = "ResumptionDate") -> DataFrame:
    """Whether it is still suspended, and for how many days it was or has been."""
    return df.withColumns({"is_suspended": (F.col(end).isNull() | (F.col(end) > as_of)).cast("int"), "suspend_days": F.datediff(F.coalesce(F.col(end), as_of), F.col(start))})


def suspensions(df: DataFrame, code: str | None = None, start: str | None = None, end: str | None = None, reason: str | None = None, current_at: Column | None = None) -> DataFrame:
    """By code, date range, keyword of the reason (any case), or those in force."""
    if code is not None:
        df = df.where(F.col("SecuCode") == code)
    if start is not None and end is not None:
        df = df.where(F.col("SuspendDate").between(start, end))
    if reason is not None:
        df = df.where(F.contains(F.lower("SuspendReason"), F.lit(reason.lower())))
    return df if current_at is None else df.where(F.col("ResumptionDate").isNull() | (F.col("ResumptionDate") > current_at))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Both tables' rows, the latest version of each key."""
    both = old.unionByName(new)
    at = F.struct(F.col(version), *[F.col(c) for c in both.columns if c != version])
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), at).alias("r")).select("r.*")


def suspension_stats(df: DataFrame, by: str) -> DataFrame:
    """Count, distinct securities and mean days by source or type."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("InnerCode").alias("stocks"), F.avg(F.when(F.col("ResumptionDate").isNotNull(), F.datediff("ResumptionDate", "SuspendDate"))).alias("avg_days"))


def shares(df: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Counts of each value with its share of all rows; the ``top`` values if that is given."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    out = n.join(F.broadcast(n.agg(F.sum("n").alias("all"))), how="cross").select(by, "n", (F.col("n") / F.col("all")).alias("share"))  # one row
    return out if top is None else out.orderBy(F.desc("n"), by).limit(top)


#: A suspension's fields, in order.
SUSPENSION = "InnerCode long, SecuCode string, SuspendDate date, ResumptionDate date, InfoSource int, SuspendReason string"


def suspension_documents(df: DataFrame, sources: dict[int, str]) -> DataFrame:
    """(InnerCode, document) as JSON text, with the source's name."""
    names = [f.split()[0] for f in SUSPENSION.split(", ")]
    return df.select("InnerCode", F.to_json(F.struct(*names, decoded("InfoSource", sources).alias("InfoSourceName"))).alias("document"))


def suspensions_from_documents(df: DataFrame, column: str = "document") -> DataFrame:
    """The suspensions that JSON texts hold; dates are parsed, texts that don't parse give NULLs, unknown fields are left out."""
    return df.select(F.from_json(column, SUSPENSION).alias("r")).select("r.*")
