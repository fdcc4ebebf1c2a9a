"""Hand-made series vs pandas rolling / ewm definitions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from candleframe.functions.indicators import features
from candleframe.operators.series import drop_layout


def _bars(spark, closes, symbol="AAA", highs=None, lows=None, vols=None):
    n = len(closes)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i, c in enumerate(closes):
        h = highs[i] if highs is not None else c + 1.0
        lo = lows[i] if lows is not None else c - 1.0
        v = vols[i] if vols is not None else 100.0 + i
        rows.append((symbol, t0 + dt.timedelta(hours=i), float(c), float(h), float(lo), float(c), float(v)))
    return spark.createDataFrame(
        rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    )


def _get(spark, closes, cols, **kw):
    df = drop_layout(features(_bars(spark, closes, **kw), cols)).select("ts", *cols).toPandas()
    return df.sort_values("ts").reset_index(drop=True)


def test_sma_std_vs_pandas(spark):
    rng = np.random.default_rng(1)
    c = 100 + rng.normal(0, 1, 60).cumsum()
    got = _get(spark, list(c), ["sma_20", "std_pop_20", "volatility"])
    s = pd.Series(c)
    np.testing.assert_allclose(got["sma_20"], s.rolling(20).mean(), rtol=1e-12, equal_nan=True)
    np.testing.assert_allclose(got["std_pop_20"], s.rolling(20).std(ddof=0), rtol=1e-9, atol=1e-12, equal_nan=True)
    np.testing.assert_allclose(got["volatility"], s.pct_change().rolling(20).std(), rtol=1e-9, equal_nan=True)


def test_ema_and_macd_vs_pandas_ewm(spark):
    rng = np.random.default_rng(2)
    c = 50 + rng.normal(0, 1, 80).cumsum()
    got = _get(spark, list(c), ["ema_12", "ema_26", "macd", "macd_signal", "volume_ema"])
    s = pd.Series(c)
    e12 = s.ewm(span=12, adjust=False, min_periods=12).mean()
    e26 = s.ewm(span=26, adjust=False, min_periods=26).mean()
    macd = e12 - e26
    sig = macd.ewm(span=9, adjust=False, min_periods=9).mean()
    np.testing.assert_allclose(got["ema_12"], e12, rtol=1e-12, equal_nan=True)
    np.testing.assert_allclose(got["macd"], macd, rtol=1e-9, atol=1e-12, equal_nan=True)
    np.testing.assert_allclose(got["macd_signal"], sig, rtol=1e-9, atol=1e-12, equal_nan=True)
    v = pd.Series(100.0 + np.arange(80))
    np.testing.assert_allclose(got["volume_ema"], v.ewm(span=20, adjust=False).mean(), rtol=1e-12)


def test_wilder_rsi_and_simple_rsi(spark):
    rng = np.random.default_rng(3)
    c = 20 + rng.normal(0, 1, 60).cumsum()
    got = _get(spark, list(c), ["rsi", "rsi_simple"])
    d = pd.Series(c).diff()
    up, dn = d.where(d > 0, 0.0), -d.where(d < 0, 0.0)
    rs = up.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() / dn.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    np.testing.assert_allclose(got["rsi"], 100 - 100 / (1 + rs), rtol=1e-9, equal_nan=True)
    rs2 = up.rolling(14).mean() / dn.rolling(14).mean()
    np.testing.assert_allclose(got["rsi_simple"], 100 - 100 / (1 + rs2), rtol=1e-9, equal_nan=True)
    assert ((got["rsi"].dropna() >= 0) & (got["rsi"].dropna() <= 100)).all()


def test_monotone_series_rsi_edges(spark):
    rise = _get(spark, [float(i) for i in range(1, 40)], ["rsi", "rsi_simple"])
    assert (rise["rsi"].dropna() == 100.0).all()
    assert (rise["rsi_simple"].dropna() == 100.0).all()
    flat = _get(spark, [5.0] * 40, ["rsi_simple", "stoch_k"])
    assert flat["rsi_simple"].isna().all()  # gain = loss = 0
    fall = _get(spark, [float(40 - i) for i in range(40)], ["rsi_simple"])
    assert (fall["rsi_simple"].dropna() == 0.0).all()


def test_atr_seeded_and_kama(spark):
    rng = np.random.default_rng(4)
    c = 30 + rng.normal(0, 1, 50).cumsum()
    h, lo = c + rng.uniform(0, 1, 50), c - rng.uniform(0, 1, 50)
    got = _get(spark, list(c), ["atr", "kama"], highs=list(h), lows=list(lo))
    pc = pd.Series(c).shift(1)
    tr = pd.concat([pd.Series(h - lo), (pd.Series(h) - pc).abs(), (pd.Series(lo) - pc).abs()], axis=1).max(axis=1)
    atr = np.full(50, np.nan)
    atr[13] = tr[:14].mean()
    for i in range(14, 50):
        atr[i] = (atr[i - 1] * 13 + tr[i]) / 14
    np.testing.assert_allclose(got["atr"], atr, rtol=1e-9, equal_nan=True)
    # KAMA seeded with the close at row 9
    assert got["kama"].iloc[:9].isna().all() and got["kama"].iloc[9] == pytest.approx(c[9])


def test_one_row_symbol_and_interleaved_symbols(spark):
    a = _bars(spark, [1.0, 2.0, 3.0] * 10, "A")
    b = _bars(spark, [7.0], "B")
    df = drop_layout(features(a.unionByName(b), ["sma_5", "ema_5", "obv"])).toPandas()
    one = df[df.symbol == "B"].iloc[0]
    assert np.isnan(one["sma_5"]) and np.isnan(one["ema_5"]) and one["obv"] == 100.0
    alone = drop_layout(features(a, ["sma_5", "ema_5", "obv"])).toPandas().sort_values("ts")
    both = df[df.symbol == "A"].sort_values("ts")
    np.testing.assert_allclose(alone["ema_5"].to_numpy(), both["ema_5"].to_numpy(), equal_nan=True)
