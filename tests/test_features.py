"""Features against pandas, and the plans that they make."""

import re

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.panel import Panel, ema_sql
from tidemark.operators import price, technical, volume
from tidemark.plans.pipeline import features

P = Panel()


def compared(df, pdf, made):
    """Largest relative difference of each column against a function of one series' frame; missing in the same places."""
    got = df.toPandas().sort_values(["SecuCode", "TradingDay"]).reset_index(drop=True)
    for name, f in made.items():
        want = pd.concat([f(g) for _, g in pdf.sort_values(["SecuCode", "TradingDay"]).groupby("SecuCode")]).reset_index(drop=True).astype(float)
        own = got[name].astype(float)
        assert (own.isna() == want.isna()).all(), name
        assert np.allclose(own.fillna(0), want.fillna(0), rtol=1e-9, atol=1e-9), name


def test_price_features(spark, walk):
    pdf, df = walk
    c = lambda g: g.ClosePrice
    compared(price.all_price(df, P), pdf, {
        "Return_5d": lambda g: c(g).pct_change(5), "LogReturn_20d": lambda g: np.log(c(g) / c(g).shift(20)), "Momentum_10d": lambda g: c(g).diff(10), "RelMomentum_20d": lambda g: (c(g) - c(g).rolling(20).mean()) / c(g).rolling(20).mean(),
        "HistVol_20d": lambda g: np.log(c(g) / c(g).shift()).rolling(20).std() * np.sqrt(252), "SMA_50": lambda g: c(g).rolling(50).mean(), "BB_Upper": lambda g: c(g).rolling(20).mean() + 2 * c(g).rolling(20).std(),
        "Support_20d": lambda g: g.LowPrice.rolling(20).min(), "Fib_618": lambda g: g.HighPrice.rolling(20).max() - 0.618 * (g.HighPrice.rolling(20).max() - g.LowPrice.rolling(20).min()),
        "ATR_20d": lambda g: pd.concat([g.HighPrice - g.LowPrice, (g.HighPrice - c(g).shift()).abs(), (g.LowPrice - c(g).shift()).abs()], axis=1).max(axis=1).rolling(20).mean(),
    })


def test_volume_features(spark, walk):
    pdf, df = walk
    v = lambda g: g.TurnoverVolume
    compared(volume.patterns(volume.price_volume(volume.indicators(df, P), P), P, year=60), pdf, {
        "Volume_Ratio_20": lambda g: v(g) / v(g).rolling(20).mean(), "PriceVolume_Corr_20": lambda g: g.ClosePrice.pct_change().rolling(20).corr(v(g)), "Volume_Percentile": lambda g: v(g).rolling(60).rank(pct=True),
        "VWAP": lambda g: ((g.HighPrice + g.LowPrice + g.ClosePrice) / 3 * v(g)).rolling(20).sum() / v(g).rolling(20).sum(),
    })


def test_exponential_means(spark, walk):
    pdf, df = walk
    fast = lambda g, a: g.ClosePrice.ewm(span=12, adjust=a).mean() - g.ClosePrice.ewm(span=26, adjust=a).mean()
    compared(technical.macd(df, P), pdf, {"MACD": lambda g: fast(g, False), "MACD_Signal": lambda g: fast(g, False).ewm(span=9, adjust=False).mean()})
    compared(technical.macd(df, P, adjust=True), pdf, {"MACD": lambda g: fast(g, True)})
    compared(df.withColumn("e", ema_sql(P, "ClosePrice", 5, 100)), pdf, {"e": lambda g: g.ClosePrice.ewm(span=5, adjust=False).mean()})


def test_invariants(spark, walk):
    got = features(walk[1], P, day="TradingDay").toPandas()
    assert len(got) == len(walk[0])
    for name, lo, hi in (("RSI_14", 0, 100), ("Stoch_K", 0, 100), ("MFI", 0, 100), ("Williams_R", -100, 0)):
        x = got[name].dropna()
        assert len(x) and x.between(lo - 1e-9, hi + 1e-9).all()
    ok = got.dropna(subset=["BB_Lower"])
    assert (ok.BB_Lower <= ok.SMA_20).all() and (ok.SMA_20 <= ok.BB_Upper).all()
    assert not (got.Bullish_Engulfing & got.Bearish_Engulfing).any()
    assert got[got.SecuCode == "c"]["SMA_20"].isna().all()


def test_one_exchange_for_all_windows(spark, walk):
    df = technical.stochastic(volume.indicators(price.trend(price.volatility(price.returns(walk[1], P), P), P), P), P)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(SecuCode", plan)) == 1 and plan.count("Exchange") == 1


def test_missing_columns_are_named(walk):
    with pytest.raises(ValueError, match="HighPrice"):
        technical.all_technical(walk[1].drop("HighPrice"), P)
    with pytest.raises(ValueError, match="close"):
        price.resolve(walk[1].drop("ClosePrice"))
