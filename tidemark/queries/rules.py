"""Rules of listings and boards, look-ahead with a target, stability by window, periods of trading days."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quality, research, timeseries
from .base import BARS, MONTH_BARS, P, W, bars, month_bars, query, read, rounded
from .frames import CAL, _calendar

LISTED = f"""{MONTH_BARS}, q AS (SELECT secu, d, CASE WHEN secu % 11 <> 0 THEN min(d) OVER (PARTITION BY secu) END AS listed, row_number() OVER {W} AS days, lag(c) OVER {W} AS pc,
    CASE secu % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN lag(c) OVER {W} * 1.1 WHEN 3 THEN lag(c) OVER {W} * 1.2 ELSE lag(c) OVER {W} * 1.15 END AS up,
    CASE WHEN secu % 3 = 0 THEN NULL ELSE l END AS down, CASE secu % 6 WHEN 5 THEN NULL ELSE secu % 6 END AS state, CASE secu % 4 WHEN 0 THEN NULL ELSE secu % 4 END AS kind, CASE WHEN secu % 7 = 0 THEN 7 ELSE secu % 7 END AS sector FROM b)"""


def _listed(spark, sf):
    when, w = lambda k, v, c: F.when(F.col("secu") % k == v, c), Window.partitionBy("secu")
    df = month_bars(spark, sf).withColumns({"days": F.row_number().over(w.orderBy("d")), "pc": P.lag("c"), "listed": F.when(F.col("secu") % 11 != 0, F.min("d").over(w))})
    up = when(5, 1, F.lit(0.0)).when(F.col("secu") % 5 == 2, F.col("pc") * 1.1).when(F.col("secu") % 5 == 3, F.col("pc") * 1.2).when(F.col("secu") % 5 == 4, F.col("pc") * 1.15)
    return df.withColumns({"up": up, "down": F.when(F.col("secu") % 3 != 0, F.col("l")), "state": F.when(F.col("secu") % 6 != 5, F.col("secu") % 6), "kind": F.when(F.col("secu") % 4 != 0, F.col("secu") % 4), "sector": when(7, 0, F.lit(7)).otherwise(F.col("secu") % 7)})


@query(f"""WITH {LISTED} SELECT secu, d, CASE WHEN listed IS NULL THEN 'listing: no day' ELSE concat_ws('; ',
    CASE WHEN days > 5 AND coalesce(up, 0) = 0 THEN 'limit: no ceiling of a ' || CASE WHEN days <= 30 THEN 'new share' ELSE 'share' END END,
    CASE WHEN days > 5 AND coalesce(down, 0) = 0 THEN 'limit: no floor of a ' || CASE WHEN days <= 30 THEN 'new share' ELSE 'share' END END,
    CASE WHEN days > 5 AND days <= 30 AND up > 0 AND pc > 0 AND abs((up - pc) / pc - CASE WHEN sector IN (6, 7) THEN 0.2 ELSE 0.1 END) > 0.001 THEN 'limit: not the board''s share' END,
    CASE WHEN state IS NULL THEN 'state: missing' WHEN state NOT IN (1, 2, 3) THEN 'state: unknown' END,
    CASE WHEN kind IS NULL THEN 'category: missing' WHEN kind <> 1 THEN 'category: no share' END) END AS "ListingIssues" FROM q""")
def listing_rules(spark, sf):
    return quality.listing_rules(_listed(spark, sf), "listed", "days", "up", "down", "pc", "state", "kind", "sector").select("secu", "d", "ListingIssues")


@query(f"WITH {LISTED.replace('AS sector FROM b', 'AS sector, c, o, v FROM b')} SELECT sector, count_if(c < CASE sector WHEN 1 THEN 0.1 ELSE 0.01 END AND c > 0) AS low, count_if(c > CASE sector WHEN 1 THEN 5000.0 ELSE 10000.0 END) AS high FROM q GROUP BY sector")
def board_prices(spark, sf):
    """Closes beyond what their board allows, by the audit's own rules."""
    df = _listed(spark, sf)
    out = quality.audited(df, ["c"], [], "c", "c", "c", "c", F.lit(False), quality.board_bounds("sector"))
    has = lambda s: F.count_if(F.contains("Issues", F.lit(s)))
    return out.groupBy("sector").agg(has("c: too low").alias("low"), has("c: too high").alias("high"))


@query(f"WITH {MONTH_BARS}, x AS (SELECT secu, d, o / lag(o) OVER {W} - 1 AS o, v / lag(v) OVER {W} - 1 AS v, sign(lead(c) OVER {W} - c) AS t FROM b), u AS (SELECT secu, d, t, 'o' AS column_name, o AS change FROM x UNION ALL SELECT secu, d, t, 'v', v FROM x) SELECT secu, d, column_name, round(change, 6) + 0.0 AS change FROM u WHERE abs(change) > 0.5 AND sign(change) = t")
def lookahead_of_target(spark, sf):
    """Jumps in the direction of the close's next move."""
    return rounded(quality.lookahead(month_bars(spark, sf), P, ["o", "v"], target="c"))


@query(f"""WITH {BARS}, r AS (SELECT d, o, v, lead(c) OVER {W} AS y FROM b), u AS (SELECT 'o' AS feature, d, o AS x, y FROM r WHERE y IS NOT NULL UNION ALL SELECT 'v', d, v, y FROM r WHERE y IS NOT NULL),
w AS (SELECT feature, x, y, 'M' AS win, date_trunc('month', d) AS p FROM u UNION ALL SELECT feature, x, y, 'Q', date_trunc('quarter', d) FROM u UNION ALL SELECT feature, x, y, 'Y', date_trunc('year', d) FROM u),
k AS (SELECT feature, win, p, rank() OVER (PARTITION BY feature, win, p ORDER BY x) + (count(*) OVER (PARTITION BY feature, win, p, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature, win, p ORDER BY y) + (count(*) OVER (PARTITION BY feature, win, p, y) - 1) / 2.0 AS ry FROM w),
i AS (SELECT feature, win, p, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM k GROUP BY feature, win, p HAVING count(*) >= 3),
c AS (SELECT *, exp(sum(ln(greatest(1 + ic, 1e-12))) OVER (PARTITION BY feature, win ORDER BY p ROWS UNBOUNDED PRECEDING)) AS cum FROM i WHERE ic IS NOT NULL),
f AS (SELECT *, cum / max(cum) OVER (PARTITION BY feature, win ORDER BY p ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM c),
g AS (SELECT feature, win AS "window", count(*) AS periods, avg(ic) AS a, stddev_samp(ic) AS s, avg(CAST(ic > 1e-12 AS INT)) AS pos, min(fall) AS fall FROM f GROUP BY feature, win)
SELECT feature, "window", periods, round(a, 6) + 0.0 AS ic_mean, round(s, 6) + 0.0 AS ic_std, round(a / nullif(s, 0), 5) + 0.0 AS icir, round(pos, 6) + 0.0 AS positive_ratio, round(fall, 6) + 0.0 AS max_drawdown, coalesce(a / nullif(s, 0) > 0.5 AND fall > -0.3, false) AS is_stable FROM g""")
def stability_by_window(spark, sf):
    """Of opening price and volume against the next close, by month, quarter and year."""
    return rounded(research.stability_by(bars(spark, sf).withColumn("y", P.lead("c")), ["o", "v"], "y", "d"), icir=5)


@query(f"WITH {CAL}, q AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS e FROM orders) SELECT q.o_orderkey, x.day AS period_start, y.day AS period_end FROM q ASOF LEFT JOIN cal x ON q.s >= x.day ASOF LEFT JOIN cal y ON q.e >= y.day")
def trading_periods(spark, sf):
    """Three months from each order, both ends on trading days."""
    q = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("s"))
    return timeseries.trading_period(q, "s", "3m", _calendar(spark, sf)).select("o_orderkey", "period_start", "period_end")
