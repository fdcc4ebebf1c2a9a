"""Which columns a model learns from: one list for each paired strategy and three longer lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The features of each paired strategy's model, in the library's column names.
FEATURE_SETS: dict[str, list[str]] = {
    "RSI + MACD": ["rsi", "macd", "macd_signal", "volume", "close"],
    "Bollinger + Stochastic": ["bb_upper", "bb_lower", "stoch_k", "stoch_d", "volume"],
    "ADX + DMI": ["adx", "dmi_plus", "dmi_minus", "volume", "close"],
    "Volume + MFI": ["volume", "volume_sma", "mfi", "close", "volume_ema"],
    "Triple Screen": ["ema_200", "rsi", "macd", "macd_signal", "volume"],
    "Trend Following": ["sma_20", "sma_50", "adx", "bb_upper", "bb_lower"],
    "Momentum + Volume": ["rsi", "volume", "volume_sma", "mfi", "close"],
    "Support Resistance": ["pivot_mean", "stoch_k", "cci", "close", "volume"],
    "Volatility Breakout": ["bb_upper", "bb_lower", "atr", "volume", "volume_sma"],
    "Price Action": ["open", "close", "volume", "volume_sma", "ema_200"],
}

# The features of the direction models, of the automatic search and of the return regressors.
FEATURES_33 = [
    "rsi", "macd", "bb_upper", "bb_lower", "sma_5", "ema_5", "volatility", "volume_sma", "volume_ema", "force_index", "ease_of_movement",
    "vpt", "ao", "kama", "ppo", "pvo", "roc", "stoch_rsi", "adx", "cci", "dpo", "mass_index", "trix", "vortex_pos", "vortex_neg",
    "bb_width", "donchian_width", "keltner_width", "atr", "hlc3", "ohlc4", "high_low_ratio", "close_open_ratio",
]
FEATURES_8 = ["rsi", "macd", "bb_upper", "bb_lower", "volume_sma", "obv", "returns", "volume_change"]
FEATURES_7 = ["rsi", "macd", "bb_upper", "bb_lower", "sma_5", "ema_5", "volatility"]


def strategy_features(f: DataFrame, digits: int = 6) -> DataFrame:
    """(symbol, ts, strategy, feature, value) for every set and bar, as rows; no shuffle."""
    entries = [
        F.struct(F.lit(s).alias("strategy"), F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), digits).alias("value"))
        for s, cols in FEATURE_SETS.items() for c in cols
    ]
    return f.select("symbol", "ts", F.inline(F.array(*entries)))
