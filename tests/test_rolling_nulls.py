"""Rolling indicators over missing prices follow pandas: NULL until the frame is full."""

import numpy as np
import pandas as pd

from candleframe.functions.indicators import features


def test_rolling_over_nulls_equals_pandas(spark):
    rng = np.random.default_rng(3)
    close = rng.normal(100, 5, 60).round(2)
    close[[7, 30]] = np.nan
    ts = pd.date_range("2024-01-01", periods=60, freq="h")
    rows = [("a", t.to_pydatetime(), *(None if np.isnan(c) else float(c),) * 4, 1.0) for t, c in zip(ts, close, strict=True)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = features(df, ["sma_5", "sma_20", "std_pop_20", "min_low_14"]).toPandas().sort_values("ts")
    s = pd.Series(close)
    want = {"sma_5": s.rolling(5).mean(), "sma_20": s.rolling(20).mean(), "std_pop_20": s.rolling(20).std(ddof=0), "min_low_14": s.rolling(14).min()}
    for name, w in want.items():
        np.testing.assert_allclose(got[name].astype(float).to_numpy(), w.to_numpy(), rtol=1e-9, err_msg=name)
