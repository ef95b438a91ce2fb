"""Validation and audit rules as data: each rule is a condition and a label, a row gets the labels that hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import quantiles
from ..functions.panel import Panel, div

#: Values that stand for missing in the vendor's tables.
PLACEHOLDERS = (-1, -999, -9999, 999, 9999, 99999)


def quote_rules(column: str, kind: str, suspended: Column, low: float = 0.01, high: float = 10_000) -> Column:
    """The first issue of a price or volume column, or NULL."""
    x = F.col(column)
    out = F.when(x.isNull(), f"{column}: null").when(x.isin(*PLACEHOLDERS), f"{column}: placeholder")
    if kind == "price":
        out = out.when((x == 0) & suspended, f"{column}: zero while suspended").when(x == 0, f"{column}: zero")
    else:
        out = out.when((x == 0) & ~suspended, f"{column}: zero")
    out = out.when(x < 0, f"{column}: negative")
    return out.when(x > high, f"{column}: too high").when((x < low) & (x > 0), f"{column}: too low") if kind == "price" else out


def audited(df: DataFrame, prices: Sequence[str], volumes: Sequence[str], o: str, h: str, low: str, c: str, suspended: Column, bounds: tuple[Column | float, Column | float] = (0.01, 10_000), factor: str | None = None) -> DataFrame:
    """``df`` with ``Issues`` (joined by '; ') and ``IssueCount``."""
    lo, hi = bounds
    rules = [quote_rules(x, "price", suspended, lo, hi) for x in prices] + [quote_rules(x, "volume", suspended) for x in volumes]
    if factor:
        f = F.col(factor)
        rules.append(F.when(f.isNull(), f"{factor}: null").when(f <= 0, f"{factor}: not positive").when(f > 1000, f"{factor}: too high").when(f < 0.001, f"{factor}: too low"))
    rules += [F.when(F.col(h) < F.col(low), "range: high under low"), F.when(F.col(c) > F.col(h), "range: close over high"), F.when(F.col(c) < F.col(low), "range: close under low")]
    df = df.withColumn("__i", F.array_compact(F.array(*rules)))
    return df.withColumns({"Issues": F.concat_ws("; ", "__i"), "IssueCount": F.size("__i")}).drop("__i")


def issue_histogram(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, issue, n) of the issues' kinds."""
    return df.where("Issues <> ''").select(*by, F.explode(F.split("Issues", "; ")).alias("i")).groupBy(*by, F.substring_index("i", ":", 1).alias("issue")).agg(F.count("*").alias("n"))


def audit_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col("IssueCount") > 0).alias("with_issues"), F.count_if(F.col("IssueCount") > 1).alias("with_several"), F.sum("IssueCount").alias("issues"))


def issues_by_age(df: DataFrame, days: str, issues: str = "Issues") -> DataFrame:
    """(days, rows, issues): rows with issues, and their issues, by the days since the listing."""
    d = df.where(F.col(issues) != "")
    return d.groupBy(F.col(days).alias("days")).agg(F.count("*").alias("rows"), F.sum(F.size(F.split(issues, "; "))).cast("long").alias("issues"))


def most_issues(df: DataFrame, by: str, k: int = 10, issues: str = "Issues") -> DataFrame:
    """(by, rows, kinds): the k keys with the most rows that have issues (ties: the lesser key), and how many kinds these have."""
    kinds = F.transform(F.split(issues, "; "), lambda i: F.substring_index(i, ":", 1))
    per = df.where(F.col(issues) != "").select(by, F.posexplode(kinds).alias("__i", "__k"))
    per = per.groupBy(by).agg(F.count_if(F.col("__i") == 0).alias("rows"), F.count_distinct("__k").alias("kinds"))
    return per.orderBy(F.desc("rows"), by).limit(k)


def field_issues(df: DataFrame, prices: Sequence[str], volumes: Sequence[str], suspended: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, field, rows, nulls, zeros, placeholders, negatives, and their shares in percent) of each field, in one pass.

    A volume of zero counts only where the quote isn't suspended; an unknown state is not a suspension.
    """
    fields = [*prices, *volumes]
    zero = lambda c: (F.col(c) == 0) if c in prices else (F.col(c) == 0) & F.nvl(~suspended, F.lit(True))
    found = {"nulls": lambda c: F.col(c).isNull(), "zeros": zero, "placeholders": lambda c: F.col(c).isin(*PLACEHOLDERS), "negatives": lambda c: F.col(c) < 0}
    one = df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.struct(F.lit(c).alias("field"), *[F.count_if(f(c)).alias(n) for n, f in found.items()]).alias(f"__{i}") for i, c in enumerate(fields)])
    out = one.select(*by, "rows", F.explode(F.array(*[F.col(f"__{i}") for i in range(len(fields))])).alias("r")).select(*by, "rows", "r.*")
    return out.withColumns({f"{n}_pct": div(F.col(n) * 100, "rows") for n in found})


def limit_rules(df: DataFrame, p: Panel, close: str, before: str, days_listed: str, sector: str, wide: Sequence[int] = (6, 7), tolerance: float = 0.001, free: int = 5, new: int = 30) -> DataFrame:
    """``LimitIssue`` of new listings: a move beyond the sector's limit after the free days, up to ``new`` days."""
    ratio = F.abs(div(F.col(close) - F.col(before), before))
    limit = F.when(F.col(sector).isin(*wide), 0.2).otherwise(0.1)
    n = F.col(days_listed)
    return df.withColumn("LimitIssue", F.when((n > free) & (n <= new) & (ratio > limit + tolerance), "beyond limit").when((n > free) & (n <= new) & ratio.isNull(), "no previous close"))


#: What a price may be on each board (fixed values); others as in ``audited``.
BOARDS = {1: (0.1, 5000.0), 6: (0.01, 10_000.0), 7: (0.01, 10_000.0)}


def board_bounds(sector: str) -> tuple[Column, Column]:
    """The least and largest price of the row's board, for ``audited``."""
    pick = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, b in BOARDS.items() for v in (k, b[i])]), F.col(sector).cast("int")), F.lit((0.01, 10_000.0)[i]))
    return pick(0), pick(1)


def listing_rules(df: DataFrame, listed: str, days: str, ceiling: str, floor: str, before: str, state: str, category: str, sector: str, wide: Sequence[int] = (6, 7), tolerance: float = 0.001, free: int = 5, new: int = 30) -> DataFrame:
    """``ListingIssues`` (joined by '; ') of a quote with the day it was listed on and the trading days since.

    Without a listing day nothing else is looked at. In the first ``free`` days limits may be missing; after them both
    are needed, and up to ``new`` days the ceiling must be the board's share over the previous close, to ``tolerance``. The
    state is to be 1, 2 or 3, the category 1.
    """
    n, missing = F.col(days), lambda c: F.col(c).isNull() | (F.col(c) == 0)
    share = div(F.col(ceiling) - F.col(before), before)
    expected = F.when(F.col(sector).isin(*wide), 0.2).otherwise(0.1)
    rules = [F.when((n > free) & missing(c), F.concat(F.lit(f"limit: no {w} "), F.when(n <= new, "of a new share").otherwise("of a share"))) for c, w in ((ceiling, "ceiling"), (floor, "floor"))]
    rules.append(F.when((n > free) & (n <= new) & (F.col(ceiling) > 0) & (F.col(before) > 0) & (F.abs(share - expected) > tolerance), "limit: not the board's share"))
    rules += [F.when(F.col(state).isNull(), "state: missing").when(~F.col(state).isin(1, 2, 3), "state: unknown"), F.when(F.col(category).isNull(), "category: missing").when(F.col(category) != 1, "category: no share")]
    every = F.concat_ws("; ", F.array_compact(F.array(*rules)))
    return df.withColumn("ListingIssues", F.when(F.col(listed).isNull(), "listing: no day").otherwise(every))


def null_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``NullColumns``: names of the columns that are NULL in the row; only rows that have some."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.withColumn("__n", names).where(F.size("__n") > 0).withColumn("NullColumns", F.concat_ws(",", "__n")).drop("__n")


def open_gap_stats(df: DataFrame, by: Sequence[str], ratio: str) -> DataFrame:
    """Distribution of open over previous close: moments, quantiles and the share within bands around one."""
    x = F.col(ratio)
    q = F.percentile(x, F.array(*[F.lit(v) for v in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)]))
    df = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), q.alias("__q"), *[F.avg((F.abs(x - 1) <= b).cast("double")).alias(f"within_{round(b * 1000)}") for b in (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1)])
    return df.withColumns({f"p{k}": F.col("__q")[i] for i, k in enumerate((1, 5, 25, 50, 75, 95, 99))}).drop("__q")


def extremes(df: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """Rows beyond k deviations from the mean of all."""
    s = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return df.join(F.broadcast(s), how="cross").where(F.abs(F.col(column) - F.col("__m")) > k * F.col("__s")).drop("__m", "__s")  # one row


def change_bands(df: DataFrame, by: Sequence[str], change: str) -> DataFrame:
    """Counts by size and direction of the change in percent."""
    x = F.col(change)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.count_if(x > 0).alias("up"), F.count_if(x < 0).alias("down"), F.count_if(x >= 9.8).alias("limit_up"), F.count_if(x <= -9.8).alias("limit_down"), F.count_if(F.abs(x) > 8).alias("large"), F.count_if((F.abs(x) > 3) & (F.abs(x) <= 8)).alias("medium"), F.count_if(F.abs(x) <= 3).alias("small"))


def average_price_ratios(df: DataFrame, value: str, volume: str, h: str, low: str) -> DataFrame:
    avg = div(value, volume)
    return df.withColumns({"avg_price": avg, "above_high": div(avg - F.col(h), h), "below_low": div(F.col(low) - avg, low)})


def quintiles(df: DataFrame, column: str, outcome: str) -> DataFrame:
    """(bucket, n, mean, std, median) of the outcome by quintile of the column (exact edges)."""
    q = df.agg(F.percentile(column, F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("__q"))
    d = df.where(F.col(column).isNotNull()).join(F.broadcast(q), how="cross")  # one row
    return d.groupBy((F.size(F.filter("__q", lambda e: e < F.col(column))) + 1).alias("bucket")).agg(F.count(outcome).alias("n"), F.avg(outcome).alias("mean"), F.stddev_samp(outcome).alias("std"), F.median(outcome).alias("median"))


def sampled(df: DataFrame, by: Column, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows of each group in the order of a hash: the same ones in every run."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))))
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def gaps(df: DataFrame, p: Panel, day: str) -> DataFrame:
    """Calendar days to the row before, and the jump from its close to this open."""
    return df.withColumn("gap_days", F.datediff(F.col(day), p.lag(day)))


def fill_open(df: DataFrame, before: str, ratio: Column, floor: str | None = None, ceiling: str | None = None, name: str = "filled_open") -> DataFrame:
    """Previous close times a ratio, within floor and ceiling."""
    x = F.col(before) * ratio
    x = x if floor is None else F.greatest(x, F.col(floor))
    return df.withColumn(name, x if ceiling is None else F.least(x, F.col(ceiling)))


# validation


def validation(df: DataFrame, required: Sequence[str], day: str | None = None) -> DataFrame:
    """One row: rows, missing required columns, repeated rows, share of missing values, dates before 1900 or after today."""
    n = len(df.columns)
    repeated = df.groupBy(*df.columns).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("repeated_rows"), F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.sum(sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0)) * F.col("__n")).alias("__m"), *([F.coalesce(F.sum(F.when(F.col(day) < F.lit("1900-01-01"), F.col("__n"))), F.lit(0)).alias("dates_too_old"), F.max(day).alias("last_date")] if day else []))
    missing = [c for c in required if c not in df.columns]
    return repeated.withColumns({"missing_columns": F.lit(",".join(missing)), "missing_share": div("__m", F.col("rows") * n), "is_empty": F.col("rows") == 0}).drop("__m")


def lookahead(df: DataFrame, p: Panel, columns: Sequence[str], limit: float = 0.5, target: str | None = None) -> DataFrame:
    """(keys, column_name, change): jumps beyond ``limit``, which may come from later knowledge; with a target, those in the direction of its next move."""
    d = df.withColumns({f"__{c}": p.pct(c) for c in columns})
    if target:
        d = d.withColumn("__next", F.signum(p.lead(target) - F.col(target)))
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__{c}").alias("change")) for c in columns]))
        return d.select(*p.by, *p.time, "__next", rows.alias("r")).select(*p.by, *p.time, "__next", "r.*").where((F.abs("change") > limit) & (F.signum("change") == F.col("__next"))).drop("__next")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__{c}").alias("change")) for c in columns]))
    return d.select(*p.by, *p.time, rows.alias("r")).select(*p.by, *p.time, "r.*").where(F.abs("change") > limit)


def target_lookahead(df: DataFrame, p: Panel, target: str, least: float = 0.001) -> DataFrame:
    """One row: deviation of the target's changes; suspicious if nearly none."""
    return df.withColumn("__c", p.pct(target)).agg(F.stddev_samp("__c").alias("std")).withColumn("suspicious", F.col("std") < least)


def validation_report(df: DataFrame, p: Panel, required: Sequence[str], columns: Sequence[str], target: str | None = None, day: str | None = None, limit: float = 0.5) -> DataFrame:
    """(check, passed, found) of all checks of a table: required columns, rows, repeats, missing values, dates, jumps, target."""
    one = validation(df, required, day)
    rows = [("columns", F.col("missing_columns") == "", F.col("missing_columns")), ("rows", ~F.col("is_empty"), F.col("rows")), ("repeats", F.col("repeated_rows") == 0, F.col("repeated_rows")), ("missing", F.coalesce("missing_share", F.lit(0.0)) == 0, F.round("missing_share", 6))]
    if day:
        rows.append(("dates", F.col("dates_too_old") == 0, F.col("dates_too_old")))
    told = lambda d, of: d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("passed"), x.cast("string").alias("found")) for n, ok, x in of])).alias("r")).select("r.*")
    out = told(one, rows)
    jumps = lookahead(df, p, columns, limit).agg(F.count("*").alias("n"))
    out = out.union(told(jumps, [("jumps", F.col("n") == 0, F.col("n"))]))
    if target:
        out = out.union(told(target_lookahead(df, p, target), [("target", ~F.coalesce("suspicious", F.lit(False)), F.round("std", 6))]))
    return out


def consistency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, outliers, negatives, zero_share): beyond 1.5 interquartile ranges, under zero, zero."""
    q = _quantiles(df, columns, {"a": 0.25, "b": 0.75}).agg(*[F.max(F.when(F.col("column_name") == c, F.array("a", "b"))).alias(f"__{c}") for c in columns])  # a row for each column
    d = df.join(F.broadcast(q), how="cross")  # one row
    out = lambda c: (F.col(c) < F.col(f"__{c}")[0] - 1.5 * (F.col(f"__{c}")[1] - F.col(f"__{c}")[0])) | (F.col(c) > F.col(f"__{c}")[1] + 1.5 * (F.col(f"__{c}")[1] - F.col(f"__{c}")[0]))
    one = d.agg(*[F.struct(F.lit(c).alias("column_name"), F.count_if(out(c)).alias("outliers"), F.count_if(F.col(c) < 0).alias("negatives"), F.avg((F.col(c) == 0).cast("double")).alias("zero_share")).alias(f"r{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(columns))])).alias("r")).select("r.*")


def categories(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values over rows, and how much commoner the commonest is than the rarest."""
    per = df.groupBy(column).agg(F.count("*").alias("n"))
    return per.agg(div(F.count("*"), F.sum("n")).alias("distinct_share"), div(F.max("n"), F.min("n")).alias("imbalance"))


def cross_columns(df: DataFrame, h: str, low: str, total: str | None = None, part: str | None = None) -> DataFrame:
    aggs = [F.count_if(F.col(h) < F.col(low)).alias("high_under_low")]
    return df.agg(*aggs, *([F.count_if(F.col(total) < F.col(part)).alias("total_under_part")] if total and part else []))


def _quantiles(df: DataFrame, columns: Sequence[str], names: dict[str, float]) -> DataFrame:
    """(column_name, one column for each share): exact quantiles of every column that has values."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*").where("x IS NOT NULL")
    return quantiles(rows.groupBy("column_name", "x").agg(F.count("*").alias("n")), ["column_name"], "x", "n", names)


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, count, mean, std, min, q25, median, q75, max) with exact quantiles (linear), from counts of distinct values in order."""
    moments = lambda c: F.struct(F.lit(c).alias("column_name"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
    one = df.agg(*[moments(c).alias(f"r{i}") for i, c in enumerate(columns)]).select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(columns))])).alias("r")).select("r.*")
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    got = _quantiles(df, columns, names)
    return one.join(F.broadcast(got), "column_name", "left").select("column_name", "count", "mean", "std", "min", *names, "max")  # a row for each column


def assert_before(df: DataFrame, day: str, as_of: str) -> DataFrame:
    """``df``, or an error if any row is not before ``as_of``."""
    last = df.agg(F.max(day).cast("string")).first()[0]
    if last is not None and last >= as_of:
        raise ValueError(f"rows of {last} are not before {as_of}")
    return df
