"""Block layout: results must not depend on the block size (halo and carry paths)."""

import math

import pandas as pd

from candleframe.functions.indicators import features
from candleframe.operators.labels import forward_labels
from candleframe.operators.series import Layout, drop_layout, index_rows

COLS = ["sma_20", "max_high_52", "cci", "stoch_d", "rsi", "macd_signal", "adx", "atr", "kama", "mass_index", "obv",
        "vwap", "aroon_osc", "volatility_norm", "returns"]


def _frame(df, cols):
    return df.select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def _same(a: pd.DataFrame, b: pd.DataFrame):
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f":
            ok = ((x - y).abs() <= 1e-9 * (1 + x.abs())) | (x.isna() & y.isna())
        else:
            ok = (x == y) | (x.isna() & y.isna())
        assert ok.all(), c


def test_row_numbers_are_dense_per_symbol(bars):
    d = index_rows(bars, Layout(block_rows=16, index_chunk="6 hours")).toPandas()
    for _, g in d.groupby("symbol"):
        g = g.sort_values("ts")
        assert list(g["_rn"]) == list(range(len(g)))
        assert list(g["_blk"]) == [r // 16 for r in range(len(g))]


def test_features_independent_of_block_size(bars):
    big = _frame(drop_layout(features(bars, COLS)), COLS)
    small = _frame(drop_layout(features(bars, COLS, Layout(block_rows=16, index_chunk="6 hours"))), COLS)
    _same(big, small)


def test_forward_labels_independent_of_block_size(bars):
    cols = ["label_up_1", "label_up_10", "label_3way", "next_return"]
    a = _frame(forward_labels(features(bars, ["returns"])), cols)
    lay = Layout(block_rows=8)
    b = _frame(forward_labels(features(bars, ["returns"], lay), lay), cols)
    _same(a, b)
    # last 10 rows of each symbol have no 10-bar-ahead label
    for _, g in a.groupby("symbol"):
        assert g["label_up_10"].tail(10).isna().all()
        assert not math.isnan(g["label_up_10"].iloc[0])
