"""Price, volume and technical features over daily bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.panel import ema_sql
from ..operators import price, technical, volume
from .base import B, BARS, FLAG_BARS, MONTH_BARS, P, R, W, bars, corr, flag_bars, lag, log, month_bars, pct, query, roll, rounded, steps

KEYS = ("secu", "d")


def chosen(df, names, digits=6, **own):
    return rounded(df.select(*KEYS, *names), digits, **own)


def _names(*patterns, windows):
    return [p.format(n) for n in windows for p in patterns]


BAR_COLS = ["o", "h", "l", "c", "v", "amt"]


@query(steps(out=[*BAR_COLS, "n"], exact=("n",), own={"amt": 2}))
def bars_daily(spark, sf):
    return rounded(bars(spark, sf).select(*KEYS, *BAR_COLS, "n"), amt=2)


@query(steps(out=[*BAR_COLS, "n"], exact=("n",), own={"amt": 2}, source=MONTH_BARS))
def bars_monthly(spark, sf):
    return rounded(month_bars(spark, sf).select(*KEYS, *BAR_COLS, "n"), amt=2)


RET = (1, 5, 20, 60, 252)


@query(steps({f"{k}_{n}d": e for n in RET for k, e in (("Return", pct("c", n)), ("LogReturn", log(f"(c / nullif({lag('c', n)}, 0))")), ("CumReturn", pct("c", n)))}, out=_names("Return_{}d", "LogReturn_{}d", "CumReturn_{}d", windows=RET)))
def returns(spark, sf):
    return chosen(price.returns(bars(spark, sf), P, B), _names("Return_{}d", "LogReturn_{}d", "CumReturn_{}d", windows=RET))


MOM = (5, 10, 20, 60)


@query(steps({f"{k}_{n}d": e for n in MOM for k, e in (("Momentum", f"c - {lag('c', n)}"), ("ROC", f"{pct('c', n)} * 100"), ("RelMomentum", f"(c - ({roll('avg', 'c', n)})) / nullif({roll('avg', 'c', n)}, 0)"))}, out=_names("Momentum_{}d", "ROC_{}d", "RelMomentum_{}d", windows=MOM)))
def momentum(spark, sf):
    return chosen(price.momentum(bars(spark, sf), P, B), _names("Momentum_{}d", "ROC_{}d", "RelMomentum_{}d", windows=MOM))


VOL = (20, 60, 252)
GK = f"0.5 * power({log('h / l')}, 2) - {2 * math.log(2) - 1!r} * power({log('c / o')}, 2)"


@query(steps({"r": log(f"(c / {lag('c')})"), "hl": f"power({log('h / l')}, 2)", "gk": f"CASE WHEN {GK} >= 0 THEN sqrt({GK}) END", "tr": f"greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))"}, {"r2": "r * r"},
             {f"{k}_{n}d": e for n in VOL for k, e in (("HistVol", f"({roll('stddev_samp', 'r', n)}) * {math.sqrt(252)!r}"), ("RealizedVol", f"sqrt(({roll('sum', 'r2', n)}) * 252.0 / {n})"), ("ParkinsonVol", f"sqrt(({roll('sum', 'hl', n)}) * 252.0 / {4 * n * math.log(2)!r})"), ("GKVol", f"({roll('avg', 'gk', n)}) * {math.sqrt(252)!r}"), ("ATR", roll("avg", "tr", n)))},
             out=_names("HistVol_{}d", "RealizedVol_{}d", "ParkinsonVol_{}d", "GKVol_{}d", "ATR_{}d", windows=VOL)))
def volatility(spark, sf):
    return chosen(price.volatility(bars(spark, sf), P, B), _names("HistVol_{}d", "RealizedVol_{}d", "ParkinsonVol_{}d", "GKVol_{}d", "ATR_{}d", windows=VOL))


TREND = (20, 50, 200)
BB = {"BB_Upper": "m + 2.0 * s", "BB_Lower": "m - 2.0 * s"}
BB2 = {"BB_Width": '("BB_Upper" - "BB_Lower") / nullif(m, 0)', "BB_Position": '(c - "BB_Lower") / nullif("BB_Upper" - "BB_Lower", 0)'}


@query(steps({"m": roll("avg", "c", 20), "s": roll("stddev_samp", "c", 20)} | {f"SMA_{n}": roll("avg", "c", n) for n in TREND}, BB | {f"PricePos_{n}": f'(c - "SMA_{n}") / nullif("SMA_{n}", 0)' for n in TREND}, BB2, out=[*_names("SMA_{}", "PricePos_{}", windows=TREND), *BB, *BB2]))
def trend_sma_bb(spark, sf):
    return chosen(price.trend(bars(spark, sf), P, B), [*_names("SMA_{}", "PricePos_{}", windows=TREND), *BB, *BB2])


@query(steps({f"Support_{n}d": roll("min", "l", n) for n in VOL} | {f"Resistance_{n}d": roll("max", "h", n) for n in VOL}, {f"PricePosition_{n}d": f'(c - "Support_{n}d") / nullif("Resistance_{n}d" - "Support_{n}d", 0)' for n in VOL}, out=_names("Support_{}d", "Resistance_{}d", "PricePosition_{}d", windows=VOL)))
def support_resistance(spark, sf):
    return chosen(price.support_resistance(bars(spark, sf), P, B), _names("Support_{}d", "Resistance_{}d", "PricePosition_{}d", windows=VOL))


FIBS = {f"Fib_{round(x * 1000)}": f"hi - {x} * (hi - lo)" for x in price.FIB}


@query(steps({"hi": roll("max", "h", 20), "lo": roll("min", "l", 20)}, FIBS, out=list(FIBS)))
def fibonacci(spark, sf):
    return chosen(price.fibonacci(bars(spark, sf), P, B), list(FIBS))


def _ema_sql(x: str, spans: dict[str, int]) -> str:
    """Recursion over the bar's number."""
    first = ", ".join(f"{x} AS {k}" for k in spans)
    more = ", ".join(f"e.{k} * {1 - 2 / (s + 1)!r} + n.{x} * {2 / (s + 1)!r}" for k, s in spans.items())
    return f"num AS (SELECT *, row_number() OVER {W} AS rn FROM b), e AS (SELECT secu, d, rn, {x}, {first} FROM num WHERE rn = 1 UNION ALL SELECT n.secu, n.d, n.rn, n.{x}, {more} FROM e JOIN num n ON n.secu = e.secu AND n.rn = e.rn + 1)"


@query(f"WITH RECURSIVE {MONTH_BARS}, {_ema_sql('c', {'e20': 20, 'e50': 50})} SELECT secu, d, round(e20, 6) + 0.0 AS \"EMA_20\", round(e50, 6) + 0.0 AS \"EMA_50\" FROM e")
def ema(spark, sf):
    """Over monthly bars of many suppliers."""
    return chosen(price.trend_ema(month_bars(spark, sf), P, B, (20, 50)), ["EMA_20", "EMA_50"])


@query(f"WITH RECURSIVE {MONTH_BARS}, {_ema_sql('c', {'f': 12, 's': 26})}, m AS (SELECT secu, d, f - s AS macd, row_number() OVER {W} AS rn FROM e), g AS (SELECT secu, d, rn, macd, macd AS sig FROM m WHERE rn = 1 UNION ALL SELECT m.secu, m.d, m.rn, m.macd, g.sig * 0.8 + m.macd * 0.2 FROM g JOIN m ON m.secu = g.secu AND m.rn = g.rn + 1) SELECT secu, d, round(macd, 6) + 0.0 AS \"MACD\", round(sig, 6) + 0.0 AS \"MACD_Signal\", round(macd - sig, 6) + 0.0 AS \"MACD_Histogram\" FROM g")
def macd(spark, sf):
    return chosen(technical.macd(month_bars(spark, sf), P, B), ["MACD", "MACD_Signal", "MACD_Histogram"])


@query(f"WITH {MONTH_BARS}, num AS (SELECT *, row_number() OVER {W} AS rn FROM b) SELECT x.secu, x.d, round(sum(power({1 - 2 / 13!r}, x.rn - y.rn) * y.c) / sum(power({1 - 2 / 13!r}, x.rn - y.rn)) - sum(power({1 - 2 / 27!r}, x.rn - y.rn) * y.c) / sum(power({1 - 2 / 27!r}, x.rn - y.rn)), 6) + 0.0 AS \"MACD\" FROM num x JOIN num y ON x.secu = y.secu AND y.rn <= x.rn GROUP BY x.secu, x.d")
def macd_adjusted(spark, sf):
    return chosen(technical.macd(month_bars(spark, sf), P, B, adjust=True), ["MACD"])


@query(f"WITH RECURSIVE {MONTH_BARS}, {_ema_sql('c', {'e5': 5})} SELECT secu, d, round(e5, 6) + 0.0 AS \"EMA_5\" FROM e")
def ema_folded(spark, sf):
    """Without Python: a fold over a frame beyond which the weights are under 1e-17."""
    return rounded(month_bars(spark, sf).select(*KEYS, ema_sql(P, "c", 5, 100).alias("EMA_5")))


VW = (5, 20, 60)
TP = "((h + l + c) / 3)"


@query(steps({"tpv": f"{TP} * v"} | {f"Volume_MA_{n}": roll("avg", "v", n) for n in VW} | {f"Volume_Std_{n}": roll("stddev_samp", "v", n) for n in VW} | {f"Volume_Change_{n}": pct("v", n) for n in VW}, {f"Volume_Ratio_{n}": f'v / nullif("Volume_MA_{n}", 0)' for n in VW}, {"VWAP": f"({roll('sum', 'tpv', 20)}) / nullif({roll('sum', 'v', 20)}, 0)"}, out=["VWAP", *_names("Volume_MA_{}", "Volume_Ratio_{}", "Volume_Std_{}", "Volume_Change_{}", windows=VW)]))
def volume_indicators(spark, sf):
    return chosen(volume.indicators(bars(spark, sf), P, B), ["VWAP", *_names("Volume_MA_{}", "Volume_Ratio_{}", "Volume_Std_{}", "Volume_Change_{}", windows=VW)])


PV = (5, 20)


@query(steps({"r": pct("c"), "cv": "c * v"}, {f"PriceVolume_Corr_{n}": corr("r", "v", n) for n in PV} | {f"m{n}": roll("avg", "c", n) for n in PV} | {f"n{n}": roll("avg", "v", n) for n in PV} | {f"w{n}": f"({roll('sum', 'cv', n)}) / nullif({roll('sum', 'v', n)}, 0)" for n in PV}, {f"PriceVolume_Divergence_{n}": f"(c - m{n}) / nullif(m{n}, 0) - (v - n{n}) / nullif(n{n}, 0)" for n in PV} | {f"VWAP_Momentum_{n}": f"(c - w{n}) / nullif(w{n}, 0)" for n in PV}, out=_names("PriceVolume_Corr_{}", "PriceVolume_Divergence_{}", "VWAP_Momentum_{}", windows=PV)))
def price_volume(spark, sf):
    return chosen(volume.price_volume(bars(spark, sf), P, B), _names("PriceVolume_Corr_{}", "PriceVolume_Divergence_{}", "VWAP_Momentum_{}", windows=PV))


@query(steps({"t": TP}, {"up": f"CASE WHEN t > {lag('t')} THEN t * v ELSE 0.0 END", "dn": f"CASE WHEN t < {lag('t')} THEN t * v ELSE 0.0 END"}, {"su": roll("sum", "up", 14), "sd": roll("sum", "dn", 14)}, {"MFI": "100 * su / nullif(su + sd, 0)"}, out=["MFI"]))
def mfi(spark, sf):
    return chosen(volume.mfi(bars(spark, sf), P, B), ["MFI"])


@query(steps({"m": roll("avg", "v", 20), "s": roll("stddev_samp", "v", 20), "held": f"list(v) OVER {R(252)}", "k": f"CASE WHEN count(v) OVER {R(5)} = 5 THEN sign(v - {lag('v', 4)}) END"}, {"Volume_ZScore": "(v - m) / nullif(s, 0)"}, {"Volume_Spike": 'CAST(coalesce("Volume_ZScore" > 2, false) AS INTEGER)', "Volume_Trend": "CAST(k AS DOUBLE)", "Volume_Percentile": "CASE WHEN len(held) = 252 THEN (len(list_filter(held, lambda y: y < v)) + (len(list_filter(held, lambda y: y = v)) + 1) / 2) / 252 END"}, out=["Volume_ZScore", "Volume_Spike", "Volume_Trend", "Volume_Percentile"], exact=("Volume_Spike",)))
def volume_patterns(spark, sf):
    return chosen(volume.patterns(bars(spark, sf), P, B), ["Volume_ZScore", "Volume_Spike", "Volume_Trend", "Volume_Percentile"])


FLOW = "((c - l) - (h - c)) / (CASE WHEN h = l THEN 1.0 ELSE h - l END) * v"
RUN = "(PARTITION BY secu ORDER BY d ROWS UNBOUNDED PRECEDING)"


@query(steps({"f": FLOW, "g": f"{pct('c')} * v"}, {"AD_Line": f"sum(f) OVER {RUN}", "VPT": f"CASE WHEN g IS NOT NULL THEN sum(g) OVER {RUN} END"}, out=["AD_Line", "VPT"], digits=4))
def ad_line_vpt(spark, sf):
    return chosen(volume.vpt(volume.ad_line(bars(spark, sf), P, B), P, B), ["AD_Line", "VPT"], 4)


ABS, CHG, VWS = (5, 20, 50, 200), (5, 10, 20), (15, 30, 60, 240)


@query(steps({"tpv": f"{TP} * v", "Volume_Current": "v"} | {f"Volume_MA_{n}": roll("avg", "v", n) for n in ABS} | {f"Volume_Change_Rate_{n}": pct("v", n) for n in CHG} | {f"Volume_Momentum_{n}": f"v - {lag('v', n)}" for n in CHG}, {f"VWAP_{n}": f"({roll('sum', 'tpv', n)}) / nullif({roll('sum', 'v', n)}, 0)" for n in VWS} | {"Turnover_Rate": "v / 1000000.0"}, out=["Volume_Current", *_names("Volume_MA_{}", windows=ABS), *_names("Volume_Change_Rate_{}", "Volume_Momentum_{}", windows=CHG), *_names("VWAP_{}", windows=VWS), "Turnover_Rate"]))
def volume_documented(spark, sf):
    return chosen(volume.volume_features(bars(spark, sf), P, B, float_shares=1e6), ["Volume_Current", *_names("Volume_MA_{}", windows=ABS), *_names("Volume_Change_Rate_{}", "Volume_Momentum_{}", windows=CHG), *_names("VWAP_{}", windows=VWS), "Turnover_Rate"])


def _bit(x: str) -> str:
    return f"CAST(coalesce({x}, false) AS INTEGER)"


DIV = {"Price_High_Unconfirmed": _bit("c = ph AND NOT v = vh"), "Price_Low_Unconfirmed": _bit("c = pl AND NOT v = vl"), "Volume_High_Unconfirmed": _bit("v = vh AND NOT c = ph"), "Volume_Low_Unconfirmed": _bit("v = vl AND NOT c = pl")}
BLOCK = {"Large_Volume": _bit("v > m * 3.0"), "Price_Deviation": _bit(f"abs(c - {TP}) / nullif({TP}, 0) > 0.02"), "Abnormal_Volume": _bit("abs(v - m) > 3 * s")}


@query(steps({"ph": roll("max", "c", 20), "pl": roll("min", "c", 20), "vh": roll("max", "v", 20), "vl": roll("min", "v", 20), "m": roll("avg", "v", 20), "s": roll("stddev_samp", "v", 20)}, DIV | BLOCK, out=[*DIV, *BLOCK], exact=(*DIV, *BLOCK)))
def divergence_and_blocks(spark, sf):
    return chosen(volume.block_trades(volume.divergence(bars(spark, sf), P, B), P, B), [*DIV, *BLOCK])


@query(steps({"ch": f"coalesce(c - {lag('c')}, 0.0)"}, {"g": "greatest(ch, 0.0)", "ls": "greatest(-ch, 0.0)"}, {"mg": roll("avg", "g", 14), "ml": roll("avg", "ls", 14)}, {"RSI_14": "100 * mg / nullif(mg + ml, 0)"}, out=["RSI_14"]))
def rsi(spark, sf):
    return chosen(technical.rsi(bars(spark, sf), P, B), ["RSI_14"])


@query(steps({"lo": roll("min", "l", 14), "hi": roll("max", "h", 14), "tr": f"greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))"}, {"Stoch_K": "100 * (c - lo) / nullif(hi - lo, 0)", "Williams_R": "-100 * (hi - c) / nullif(hi - lo, 0)"}, {"Stoch_D": roll("avg", '"Stoch_K"', 3), "ATR_14": roll("avg", "tr", 14)}, out=["Stoch_K", "Stoch_D", "Williams_R", "ATR_14"]))
def oscillators(spark, sf):
    df = technical.atr(technical.williams_r(technical.stochastic(bars(spark, sf), P, B), P, B), P, B)
    return chosen(df, ["Stoch_K", "Stoch_D", "Williams_R", "ATR_14"])


CANDLES = {"Hammer": _bit("least(o, c) - l > 2 * abs(c - o) AND h - greatest(o, c) < abs(c - o) AND c > o"), "Hanging_Man": _bit("least(o, c) - l > 2 * abs(c - o) AND h - greatest(o, c) < abs(c - o) AND c < o"), "Doji": _bit("abs(c - o) < 0.1 * (h - l)"), "Bullish_Engulfing": _bit("c > o AND pc < po AND o < pc AND c > po"), "Bearish_Engulfing": _bit("c < o AND pc > po AND o > pc AND c < po")}


@query(steps({"po": lag("o"), "pc": lag("c")}, CANDLES, out=list(CANDLES), exact=tuple(CANDLES)))
def candlesticks(spark, sf):
    return chosen(technical.candlesticks(bars(spark, sf), P, B), list(CANDLES))


CAL = {"DayOfWeek": "CAST(isodow(d) - 1 AS INTEGER)", "Month": "CAST(month(d) AS INTEGER)", "Quarter": "CAST(quarter(d) AS INTEGER)", "DayOfYear": "CAST(dayofyear(d) AS INTEGER)", "WeekOfYear": "CAST(week(d) AS INTEGER)"}
for _n, _u in (("Month", "month"), ("Quarter", "quarter"), ("Year", "year")):
    CAL |= {f"Is{_n}Start": _bit(f"date_trunc('{_u}', d) = d"), f"Is{_n}End": _bit(f"date_trunc('{_u}', d + INTERVAL 1 DAY) = d + INTERVAL 1 DAY")}


@query(steps(CAL, out=list(CAL), exact=tuple(CAL)))
def calendar_features(spark, sf):
    return chosen(technical.calendar(bars(spark, sf), "d"), list(CAL))


@query(steps({"r": pct("c")}, {"Monthly_Seasonality": "avg(r) OVER (PARTITION BY secu, month(d))", "Weekly_Seasonality": "avg(r) OVER (PARTITION BY secu, isodow(d))"}, out=["Monthly_Seasonality", "Weekly_Seasonality"]))
def seasonality(spark, sf):
    return chosen(technical.seasonality(bars(spark, sf), P, B, "d"), ["Monthly_Seasonality", "Weekly_Seasonality"])


@query(f"WITH {FLAG_BARS}, j AS (SELECT x.secu, x.d, x.c, y.c AS e FROM b x LEFT JOIN b y ON y.secu = 'N' AND y.d = x.d WHERE x.secu <> 'N'), k AS (SELECT *, {corr('c', 'e', 20)} AS r FROM j) SELECT secu, d, round(c - e, 6) + 0.0 AS \"Spread_vs_N\", round(c / nullif(e, 0), 6) + 0.0 AS \"Ratio_vs_N\", round(r, 6) + 0.0 AS \"Corr_vs_N\" FROM k")
def cross_asset(spark, sf):
    b = flag_bars(spark, sf)
    return chosen(price.cross_asset(b.where("secu <> 'N'"), b.where("secu = 'N'"), P, ["d"], "c", "N"), ["Spread_vs_N", "Ratio_vs_N", "Corr_vs_N"])


@query(steps({"Momentum": pct("c", 21)}, out=["Momentum"]))
def momentum_factor(spark, sf):
    return chosen(price.momentum_factor(bars(spark, sf), P, "c"), ["Momentum"])


@query()
def technical_summary(spark, sf):
    """No SQL: MACD over long daily series is recursive."""
    df = technical.macd(technical.candlesticks(technical.bollinger(technical.rsi(bars(spark, sf), P, B), P, B), P, B), P, B)
    return rounded(technical.summary(df, P))


@query()
def feature_pipeline(spark, sf):
    """All groups on one window layout; their parts have SQL of their own."""
    from ..plans.pipeline import features

    df = features(bars(spark, sf), P, b=B, day="d")
    return rounded(df, 4)


@query(f"WITH {BARS} SELECT count(*) AS rows, count(DISTINCT secu) AS series, min(d) AS first, max(d) AS last, round((count(*) - count(CASE WHEN day(d) > 3 THEN o END)) / (count(*) * 9), 6) + 0.0 AS missing_share FROM b")
def table_report(spark, sf):
    """One of nine columns misses the first days of each month."""
    from ..plans.pipeline import report

    return rounded(report(bars(spark, sf).withColumn("o", F.when(F.dayofmonth("d") > 3, F.col("o"))), P))
