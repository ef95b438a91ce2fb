"""Long series in slices, order statistics of windows, splines, and information by neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rolling, slices
from ..operators import alternative, information, lexicon, price, technical
from ..streaming import state
from .audit import holes
from .base import BARS, B, P, R, W, bars, lag, pct, query, read, roll, rounded, steps
from .features import _ema_sql

#: The regions' daily series have some 2,400 rows each; slices of so many make several of each.
SLICE = 500


@query(f"WITH RECURSIVE {BARS}, {_ema_sql('c', {'f': 12, 's': 26})} SELECT secu, d, round(f, 6) + 0.0 AS fast, round(s, 6) + 0.0 AS slow FROM e")
def means_in_slices(spark, sf):
    """Exponential means of daily series, each slice from the state that the ones before it leave."""
    out = slices.ema_in_slices(bars(spark, sf), P, {"fast": ("c", 12), "slow": ("c", 26)}, rows=SLICE)
    return rounded(out.select("secu", "d", "fast", "slow"))


@query(steps({"m": roll("avg", "c", 60), "s": roll("stddev_samp", "c", 60), "y": f"lead(c, 5) OVER {W}", "x": f"lag(c, 252) OVER {W}"}, out=["m", "s", "x", "y"]))
def windows_in_slices(spark, sf):
    """Windows back over a year and five rows ahead, over slices with halos."""
    add = lambda df, p: df.withColumns({"m": p.mean("c", 60), "s": p.std("c", 60), "x": p.lag("c", 252), "y": p.lead("c", 5)})
    return rounded(slices.in_slices(bars(spark, sf), P, add, 252, 5, rows=SLICE).select("secu", "d", "m", "s", "x", "y"))


SO_FAR = "(PARTITION BY secu ORDER BY d ROWS UNBOUNDED PRECEDING)"


@query(steps({"total": f"sum(v) OVER {SO_FAR}", "days": f"count(v) OVER {SO_FAR}", "low": f"min(l) OVER {SO_FAR}", "high": f"max(h) OVER {SO_FAR}", "seen": f"last_value(CASE WHEN day(d) % 7 <> 3 THEN c END IGNORE NULLS) OVER {SO_FAR}"}, out=["total", "days", "low", "high", "seen"], exact=("days",), own={"total": 2}))
def running_in_slices(spark, sf):
    """Values so far, carried over slices as prefixes."""
    seen = F.when(F.dayofmonth("d") % 7 != 3, F.col("c"))
    out = slices.running(bars(spark, sf), P, {"total": ("sum", "v"), "days": ("count", "v"), "low": ("min", "l"), "high": ("max", "h"), "seen": ("last", seen)}, rows=SLICE)
    return rounded(out.select("secu", "d", "total", "days", "low", "high", "seen"), total=2)


def _features(df, p):
    return technical.bollinger(price.momentum(price.returns(df, p, B), p, B), p, B)


GROUPS = {f"Return_{n}d": pct("c", n) for n in (1, 5, 20, 60, 252)} | {f"Momentum_{n}d": f"c - {lag('c', n)}" for n in (5, 10, 20, 60)} | {"BB_Middle": roll("avg", "c", 20)}


@query(steps(GROUPS, out=list(GROUPS)))
def features_in_slices(spark, sf):
    """The feature groups' own functions, given slices with halos."""
    out = slices.in_slices(bars(spark, sf), P, _features, 300, rows=SLICE)
    return rounded(out.select("secu", "d", *GROUPS))


@query(steps({"q1": f"CASE WHEN count(c) OVER {R(120)} = 120 THEN quantile_cont(c, 0.25) OVER {R(120)} END", "q2": f"CASE WHEN count(c) OVER {R(120)} = 120 THEN quantile_cont(c, 0.5) OVER {R(120)} END", "q3": f"CASE WHEN count(v) OVER {R(120)} = 120 THEN quantile_cont(v, 0.9) OVER {R(120)} END"}, out=["q1", "q2", "q3"]))
def rolling_quantiles(spark, sf):
    out = rolling.quantiles(bars(spark, sf), P, {"q1": ("c", 0.25), "q2": ("c", 0.5), "q3": ("v", 0.9)}, 120)
    return rounded(out.select("secu", "d", "q1", "q2", "q3"))


@query()
def spline_imputed(spark, sf):
    """Cubic and quadratic splines through the known closes; as a dense system gives (tests)."""
    from ..operators import clean

    gaps = holes(spark, sf).select("secu", "d", "c", F.col("c").alias("q"))
    return rounded(clean.interpolation_imputed(clean.interpolation_imputed(gaps, P, ["c"], "spline"), P, ["q"], "polynomial", 2))


NEAR = f"""WITH {BARS}, t AS (SELECT secu, date_trunc('month', d) AS month, avg(o) AS o, sum(v) AS v, avg(c) AS c FROM b GROUP BY 1, 2),
s AS (SELECT stddev_pop(o) AS so, stddev_pop(v) AS sv, stddev_pop(c) AS sc FROM t),
p AS (SELECT 'o' AS feature, row_number() OVER () AS i, o / so AS x, c / sc AS y FROM t, s UNION ALL SELECT 'v', row_number() OVER (), v / sv, c / sc FROM t, s),
r AS (SELECT * FROM (SELECT a.feature, a.i, a.x, a.y, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS r, row_number() OVER (PARTITION BY a.feature, a.i ORDER BY greatest(abs(a.x - b.x), abs(a.y - b.y))) AS k FROM p a JOIN p b ON a.feature = b.feature AND a.i <> b.i) WHERE k = 3),
m AS (SELECT r.feature, r.i, count_if(CASE WHEN r.r > 0 THEN abs(r.x - p.x) < r.r * (1 - 1e-9) ELSE p.x = r.x END) AS mx, count_if(CASE WHEN r.r > 0 THEN abs(r.y - p.y) < r.r * (1 - 1e-9) ELSE p.y = r.y END) AS my FROM r JOIN p ON p.feature = r.feature GROUP BY r.feature, r.i),
n AS (SELECT count(*) AS n FROM t),
g AS (SELECT i, sum(CASE WHEN i > 1 THEN 1.0 / (i - 1) ELSE 0.0 END) OVER (ORDER BY i) AS h FROM (SELECT unnest(range(1, n + 1)) AS i FROM n))
SELECT m.feature, n.n, round(greatest(0.0, (SELECT h FROM g WHERE i = n.n) + 1.5 - avg(x.h) - avg(y.h)), 6) + 0.0 AS mi FROM m JOIN g x ON x.i = m.mx JOIN g y ON y.i = m.my, n GROUP BY m.feature, n.n"""


@query(NEAR)
def neighbour_information(spark, sf):
    """Of the regions' monthly opening price and volume with the closing price, by three neighbours."""
    months = bars(spark, sf).groupBy("secu", F.trunc("d", "month").alias("month")).agg(F.avg("o").alias("o"), F.sum("v").alias("v"), F.avg("c").alias("c"))
    return rounded(information.neighbour_information(months, ["o", "v"], "c"))


#: Where the events are cut in two.
HALF = "2024-01-15 12:00:00"
RUNS = "WINDOW r AS (PARTITION BY user_id, k ORDER BY ts ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY user_id, k ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
FIGURES = "min(value) OVER r AS low, max(value) OVER r AS high, sum(value) OVER r AS total, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std, count(*) OVER w AS window_n"
SHOWN = ", ".join(f"round(CAST({c} AS DOUBLE), 4) + 0.0 AS {c}" for c in ("low", "high", "total", "mean", "std", "window_n"))


def _events(spark, sf):
    return read(spark, sf, "events").select("user_id", "ts", "value", (F.col("event_type") == "error").alias("again"))


def _shown(df):
    return rounded(df.select("user_id", F.col("ts"), "low", "high", "total", "mean", "std", "window_n"), 4)


@query(f"SELECT user_id, ts, {SHOWN} FROM (SELECT user_id, ts, {FIGURES} FROM (SELECT *, 0 AS k FROM events) {RUNS}) WHERE ts >= TIMESTAMP '{HALF}'")
def continued_stats(spark, sf):
    """The second half's running values, from a table of the states that the first half leaves."""
    e = _events(spark, sf)
    held = state.states_of(e.where(F.col("ts") < F.lit(HALF).cast(e.schema["ts"].dataType)), "user_id", "ts", "value")
    return _shown(state.continued(e.where(F.col("ts") >= F.lit(HALF).cast(e.schema["ts"].dataType)), "user_id", "ts", "value", before=held))


@query(f"SELECT user_id, ts, {SHOWN} FROM (SELECT user_id, ts, {FIGURES} FROM (SELECT *, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM events) {RUNS})")
def reset_stats(spark, sf):
    """Running values that begin anew at each error."""
    return _shown(state.continued(_events(spark, sf), "user_id", "ts", "value", reset="again"))


@query("WITH s AS (SELECT user_id, CAST(count(value) AS DOUBLE) AS n, min(value) AS low, max(value) AS high, sum(value) AS total, CAST(least(count(value), 20) AS INTEGER) AS xs FROM events GROUP BY user_id) SELECT user_id, name, 'numeric' AS kind, CAST(NULL AS INTEGER) AS length, round(value, 4) + 0.0 AS value FROM (SELECT user_id, unnest(['n', 'low', 'high', 'total']) AS name, unnest([n, low, high, total]) AS value FROM s) UNION ALL SELECT user_id, 'xs', 'rolling_window', xs, CAST(NULL AS DOUBLE) FROM s")
def state_summary(spark, sf):
    """What each key's state holds after all events."""
    told = state.described(state.states_of(_events(spark, sf), "user_id", "ts", "value"))
    return rounded(told.where(F.col("name").isin("n", "low", "high", "total", "xs")), 4)


def _parted(k: int) -> str:
    """The bands of x{k}: mirrored values, then one sum of eight products for every other place."""
    place = f"((e.e % (2 * e.n)) + 2 * e.n) % (2 * e.n)"
    return f"""e{k} AS (SELECT secu, n, unnest(range(-6, n + 7)) AS e FROM (SELECT secu, max(n) AS n FROM x{k} GROUP BY secu)),
m{k} AS (SELECT e.secu, e.e, x.x FROM e{k} e JOIN x{k} x ON x.secu = e.secu AND x.i = CASE WHEN {place} < e.n THEN {place} ELSE 2 * e.n - 1 - {place} END),
c{k} AS (SELECT a.secu, (a.e - 1) // 2 AS i, sum(f.a * b.x) AS a, sum(f.d * b.x) AS d FROM m{k} a CROSS JOIN f JOIN m{k} b ON b.secu = a.secu AND b.e = a.e - f.j WHERE a.e >= 1 AND a.e % 2 = 1 GROUP BY a.secu, a.e),
x{k + 1} AS (SELECT secu, i, a AS x, count(*) OVER (PARTITION BY secu) AS n FROM c{k})"""


def _waves() -> str:
    low = alternative.daubechies(4)
    filters = ", ".join(f"({j}, {float(low[7 - j])!r}, {float(low[j] * (-1) ** (j + 1))!r})" for j in range(8))
    return f"""WITH {BARS}, f AS (SELECT * FROM (VALUES {filters}) AS t(j, a, d)), x1 AS (SELECT secu, row_number() OVER {W} - 1 AS i, c AS x, count(*) OVER (PARTITION BY secu) AS n FROM b),
{_parted(1)}, {_parted(2)}, {_parted(3)},
g AS (SELECT secu, 'D1' AS band, avg(d) AS m FROM c1 GROUP BY secu UNION ALL SELECT secu, 'D2', avg(d) FROM c2 GROUP BY secu UNION ALL SELECT secu, 'D3', avg(d) FROM c3 GROUP BY secu UNION ALL SELECT secu, 'A3', avg(a) FROM c3 GROUP BY secu)
SELECT secu, {", ".join(f"round(max(CASE WHEN band = '{b}' THEN m END), 6) + 0.0 AS c_{b}" for b in ("A3", "D3", "D2", "D1"))} FROM g GROUP BY secu"""


@query(_waves())
def wavelet(spark, sf):
    """Bands with mirrored ends."""
    return rounded(alternative.wavelet(bars(spark, sf), ["secu"], "d", "c"))


#: The fold of a text: texts of fold 0 are not learned from.
FOLD = "doc_id % 5"
TOLD = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+'), lambda w: w <> '')"
LEARNED = f"""t AS (SELECT documents.doc_id, CAST(quality AS INTEGER) AS y, {TOLD} AS w FROM documents JOIN labels ON labels.doc_id = documents.doc_id WHERE documents.{FOLD} <> 0 AND quality IN (0, 1)),
z AS (SELECT sum(y) AS p, sum(1 - y) AS q FROM t),
u AS (SELECT doc_id, y, unnest(list_distinct(w)) AS word FROM t),
l AS (SELECT word, count(*) AS n, greatest(-1.0, least(1.0, (log2((sum(y) + 0.5) / (max(p) + 1.0)) - log2((sum(1 - y) + 0.5) / (max(q) + 1.0))) / 4.0)) AS weight FROM u, z GROUP BY word HAVING count(*) >= 5)"""
NEG, MORE, LESS = (", ".join(f"'{w}'" for w in words) for words in (lexicon.NEGATORS, lexicon.INTENSIFIERS, lexicon.DOWNTONERS))


def _lexicon(spark, sf):
    both = read(spark, sf, "documents").select("doc_id", "text").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return lexicon.learned(both.where(FOLD + " <> 0"), "text", "quality")


@query(f"WITH {LEARNED} SELECT word, n, round(weight, 6) + 0.0 AS weight FROM l")
def learned_lexicon(spark, sf):
    """Words by how they go with texts labelled good or bad."""
    return rounded(_lexicon(spark, sf))


@query(f"""WITH {LEARNED}, k AS (SELECT doc_id, {TOLD} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM k),
f AS (SELECT doc_id, w[i] AS word, (CASE WHEN len(list_filter(w[greatest(i - 3, 1):i - 1], lambda x: x IN ({NEG}))) > 0 THEN -0.5 ELSE 1.0 END) * (CASE WHEN i > 1 AND w[i - 1] IN ({MORE}) THEN 1.5 WHEN i > 1 AND w[i - 1] IN ({LESS}) THEN 0.5 ELSE 1.0 END) AS f FROM p),
s AS (SELECT doc_id, count(*) AS words, sum(f * weight) AS a, sum(abs(f * weight)) AS b FROM f JOIN l ON l.word = f.word GROUP BY doc_id)
SELECT documents.doc_id, coalesce(words, 0) AS words, round(coalesce(a / nullif(b, 0), 0.0), 6) + 0.0 AS sentiment FROM documents LEFT JOIN s ON s.doc_id = documents.doc_id""")
def lexicon_sentiment(spark, sf):
    """Every document's score by the learned lexicon."""
    return rounded(lexicon.scored(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", _lexicon(spark, sf)))
