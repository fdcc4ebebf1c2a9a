"""Rule signals over the feature frame.

Each rule is a row predicate; a 3-way rule gives 1 (buy) / -1 (sell) / 0, a 2-way rule
1 / -1. A NULL predicate (warm-up rows) falls through to the last branch, as a NaN
comparison does in the reference. All signals of a frame are one projection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The 35 strategy rules (name, buy predicate, sell predicate or None for a
# 2-way rule). Thresholds and column comparisons must equal the reference's.
STRATEGY_RULES: list[tuple[str, str, str | None]] = [
    ("rsi_signal", "rsi < 30", "rsi > 70"),
    ("macd_signal", "macd > macd_signal", None),
    ("bb_signal", "close < bb_lower", "close > bb_upper"),
    ("ma_cross", "sma_5 > ema_5", None),
    ("vpt_signal", "vpt > prev_vpt", None),
    ("adx_signal", "adx > 25 AND vortex_pos > vortex_neg", "adx > 25 AND vortex_pos < vortex_neg"),
    ("cci_signal", "cci < -100", "cci > 100"),
    ("ichimoku_signal", "ichimoku_a > ichimoku_b", None),
    ("trix_signal", "trix > prev_trix", None),
    ("force_index_signal", "force_index > 0", None),
    ("eom_signal", "ease_of_movement > 0", None),
    ("ao_signal", "ao > 0", None),
    ("stoch_rsi_signal", "stoch_rsi < 0.2", "stoch_rsi > 0.8"),
    ("volatility_breakout", "close > prev_close + atr", "close < prev_close - atr"),
    ("momentum_combined", "roc > 0 AND ppo > 0 AND kama > close", None),
    ("kama_cross", "close > kama", None),
    ("volume_surge", "volume > volume_sma * 2", None),
    ("price_channel_breakout", "close > max_high_20", "close < min_low_20"),
    ("triple_ema", "ema_5 > ema_10 AND ema_10 > ema_20", "ema_5 < ema_10 AND ema_10 < ema_20"),
    ("elder_ray", "high > ema_13 AND low > ema_13", "high < ema_13 AND low < ema_13"),
    ("supertrend", "close > high_avg_10 + atr * 3", "close < low_avg_10 - atr * 3"),
    ("squeeze_momentum", "(bb_upper - bb_lower) < atr * 2", None),
    ("vwap_cross", "close > vwap", None),
    ("dmi_signal", "plus_di > minus_di AND adx > 25", "plus_di < minus_di AND adx > 25"),
    ("williams_r", "williams_r < -80", "williams_r > -20"),
    ("ultimate_oscillator", "ultimate_osc < 30", "ultimate_osc > 70"),
    ("aroon_oscillator", "aroon_osc > 50", "aroon_osc < -50"),
    ("chaikin_money_flow", "cmf > 0.2", "cmf < -0.2"),
    ("on_balance_volume", "obv > prev_obv", None),
    ("momentum_quality", "rsi > 50 AND macd > 0 AND ao > 0", "rsi < 50 AND macd < 0 AND ao < 0"),
    ("trend_strength", "adx > 25 AND plus_di > minus_di", "adx > 25 AND plus_di < minus_di"),
    (
        "volume_trend_confirm",
        "close > sma_20 AND volume > volume_sma",
        "close < sma_20 AND volume > volume_sma",
    ),
    ("volatility_regime", "atr < atr_avg_20", None),
    (
        "price_momentum",
        "(close - close_lag10) / NULLIF(close_lag10, 0) > 0.02",
        "(close - close_lag10) / NULLIF(close_lag10, 0) < -0.02",
    ),
    (
        "trend_reversal",
        "macd > 0 AND rsi < 30 AND cci < -100",
        "macd < 0 AND rsi > 70 AND cci > 100",
    ),
]

# Strategy descriptions (24 of the 35 are described) and the default text.
STRATEGY_DESCRIPTIONS: list[tuple[str, str]] = [
    ("rsi_signal", "RSI-based strategy: Buy when RSI < 30 (oversold), Sell when RSI > 70 (overbought)"),
    ("macd_signal", "MACD strategy: Buy when MACD crosses above signal line, Sell when below"),
    ("bb_signal", "Bollinger Bands strategy: Buy at lower band, Sell at upper band"),
    ("ma_cross", "Moving Average Cross strategy: Buy when short MA crosses above long MA, Sell when below"),
    ("vpt_signal", "Volume Price Trend strategy: Buy on positive trend, Sell on negative trend"),
    ("adx_signal", "ADX Strategy: Buy/Sell based on trend strength and Vortex indicators"),
    ("cci_signal", "CCI Strategy: Buy when CCI < -100 (oversold), Sell when CCI > 100 (overbought)"),
    ("ichimoku_signal", "Ichimoku Cloud strategy: Buy above cloud, Sell below cloud"),
    ("trix_signal", "TRIX strategy: Buy on positive crossover, Sell on negative crossover"),
    ("force_index_signal", "Force Index strategy: Buy on positive force, Sell on negative force"),
    ("eom_signal", "Ease of Movement strategy: Buy on positive EOM, Sell on negative EOM"),
    ("ao_signal", "Awesome Oscillator strategy: Buy on positive AO, Sell on negative AO"),
    ("stoch_rsi_signal", "Stochastic RSI strategy: Buy < 0.2 (oversold), Sell > 0.8 (overbought)"),
    ("volatility_breakout", "Volatility Breakout strategy: Buy/Sell on ATR-based breakouts"),
    ("momentum_combined", "Combined Momentum strategy using ROC, PPO, and KAMA"),
    ("kama_cross", "KAMA Cross strategy: Buy above KAMA, Sell below KAMA"),
    ("volume_surge", "Volume Surge strategy: Signals based on abnormal volume"),
    ("price_channel_breakout", "Price Channel Breakout strategy using highs/lows"),
    ("triple_ema", "Triple EMA strategy using 5, 10, and 20-period EMAs"),
    ("elder_ray", "Elder Ray strategy using EMA and high/low prices"),
    ("supertrend", "Supertrend strategy using ATR-based trend following"),
    ("squeeze_momentum", "Squeeze Momentum strategy using Bollinger Bands and ATR"),
    ("vwap_cross", "VWAP Cross strategy: Buy above VWAP, Sell below VWAP"),
    ("dmi_signal", "DMI strategy using ADX and DI indicators"),
]
DEFAULT_DESCRIPTION = "Strategy description not available"

# The 10 paired strategies (name, bullish, bearish). ``stoch`` is stoch_k,
# ``stoch_signal`` stoch_d, DI are the simple-mean DI, pivot the 20-bar typical-price mean.
PAIRED_RULES: list[tuple[str, str, str]] = [
    ("RSI + MACD", "rsi < 30 AND macd > macd_signal", "rsi > 70 AND macd < macd_signal"),
    (
        "Bollinger + Stochastic",
        "close < bb_lower AND stoch_k < 20 AND stoch_k > stoch_d",
        "close > bb_upper AND stoch_k > 80 AND stoch_k < stoch_d",
    ),
    ("ADX + DMI", "adx > 25 AND dmi_plus > dmi_minus", "adx > 25 AND dmi_plus < dmi_minus"),
    ("Volume + MFI", "volume > volume_sma AND mfi < 20", "volume > volume_sma AND mfi > 80"),
    (
        "Triple Screen",
        "ema_200 < close AND rsi < 30 AND macd > macd_signal",
        "ema_200 > close AND rsi > 70 AND macd < macd_signal",
    ),
    (
        "Trend Following",
        "sma_20 > sma_50 AND adx > 25 AND close > bb_upper",
        "sma_20 < sma_50 AND adx > 25 AND close < bb_lower",
    ),
    (
        "Momentum + Volume",
        "rsi > 50 AND volume > volume_sma AND mfi > 50",
        "rsi < 50 AND volume > volume_sma AND mfi < 50",
    ),
    (
        "Support Resistance",
        "close > pivot_mean AND stoch_k < 30 AND cci < -100",
        "close < pivot_mean AND stoch_k > 70 AND cci > 100",
    ),
    (
        "Volatility Breakout",
        "close > bb_upper AND atr > atr_avg_20 AND volume > volume_sma",
        "close < bb_lower AND atr > atr_avg_20 AND volume > volume_sma",
    ),
    (
        "Price Action",
        "close > open AND close > prev_close AND volume > volume_sma",
        "close < open AND close < prev_close AND volume > volume_sma",
    ),
]

MARKET_DIRECTION_THRESHOLD = 0.2


def rule_case(buy: str, sell: str | None) -> str:
    if sell is None:
        return f"CASE WHEN {buy} THEN 1 ELSE -1 END"
    return f"CASE WHEN {buy} THEN 1 WHEN {sell} THEN -1 ELSE 0 END"


def paired_case(bull: str, bear: str) -> tuple[str, str, str]:
    bull_b = f"coalesce({bull}, false)"
    bear_b = f"coalesce({bear}, false)"
    sig = (
        f"CASE WHEN {bull_b} AND NOT {bear_b} THEN 'bullish' "
        f"WHEN {bear_b} AND NOT {bull_b} THEN 'bearish' ELSE 'neutral' END"
    )
    return bull_b, bear_b, sig


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


_IDENT = re.compile(r"[a-z_][a-z0-9_]*")
_SQL_WORDS = {"and", "or", "not", "case", "when", "then", "else", "end", "nullif", "coalesce", "false", "true", "null"}


def referenced_columns(*exprs: str | None) -> list[str]:
    out: list[str] = []
    for e in exprs:
        if e:
            for tok in _IDENT.findall(e):
                if tok not in _SQL_WORDS and tok not in out:
                    out.append(tok)
    return out


def strategy_columns() -> list[str]:
    return referenced_columns(*[x for r in STRATEGY_RULES for x in r[1:]])


def paired_columns() -> list[str]:
    return referenced_columns(*[x for r in PAIRED_RULES for x in r[1:]])


def with_strategy_signals(f: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add ``sig_<name>`` int columns, ``combined_signal`` (mean of all 35, only when all
    are requested) and ``market_direction``."""
    rules = [r for r in STRATEGY_RULES if names is None or r[0] in names]
    cols = {f"sig_{n}": F.expr(rule_case(b, s)).cast("int") for n, b, s in rules}
    out = f.withColumns(cols)
    if names is None:
        total = sum((F.col(f"sig_{n}") for n, _, _ in STRATEGY_RULES), F.lit(0))
        out = out.withColumn("combined_signal", total.cast("double") / float(len(STRATEGY_RULES)))
        out = out.withColumn(
            "market_direction",
            F.when(F.col("combined_signal") > MARKET_DIRECTION_THRESHOLD, "Uptrend")
            .when(F.col("combined_signal") < -MARKET_DIRECTION_THRESHOLD, "Downtrend")
            .otherwise("Sideways"),
        )
    return out


def signals_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide ``sig_*`` columns -> rows (keys..., strategy, signal) through one Generate."""
    names = [n for n, _, _ in STRATEGY_RULES]
    pairs = ", ".join(f"'{n}', sig_{n}" for n in names)
    return wide.selectExpr(*keys, f"stack({len(names)}, {pairs}) AS (strategy, signal)")


def with_paired_strategies(f: DataFrame) -> DataFrame:
    cols: dict[str, Column] = {}
    for name, bull, bear in PAIRED_RULES:
        s = slug(name)
        bb, br, sig = paired_case(bull, bear)
        cols[f"{s}_bullish"] = F.expr(bb)
        cols[f"{s}_bearish"] = F.expr(br)
        cols[f"{s}_signal"] = F.expr(sig)
    return f.withColumns(cols)


def paired_long(f: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys..., strategy) with bullish / bearish / rule signal."""
    parts = []
    for name, bull, bear in PAIRED_RULES:
        bb, br, sig = paired_case(bull, bear)
        parts.append(f"'{name}', {bb}, {br}, {sig}")
    return f.selectExpr(*keys, f"stack({len(PAIRED_RULES)}, {', '.join(parts)}) AS (strategy, bullish, bearish, rule_signal)")


MARKET_STATE_SQL = (
    "(CASE WHEN adx > 25 THEN CASE WHEN close > sma_20 THEN 1 ELSE -1 END ELSE 0 END"
    " + CASE WHEN rsi > 70 THEN -1 WHEN rsi < 30 THEN 1 ELSE 0 END"
    " + CASE WHEN stoch_k > 80 THEN -1 WHEN stoch_k < 20 THEN 1 ELSE 0 END"
    " + CASE WHEN volume > volume_sma THEN CASE WHEN close > sma_20 THEN 1 ELSE -1 END ELSE 0 END)"
)


def with_market_state(f: DataFrame) -> DataFrame:
    """Additive trend score and its label (uptrend >= 2, downtrend <= -2)."""
    score = F.expr(MARKET_STATE_SQL).cast("int")
    return f.withColumn("trend_score", score).withColumn(
        "market_state",
        F.when(F.col("trend_score") >= 2, "uptrend").when(F.col("trend_score") <= -2, "downtrend").otherwise("sideways"),
    )


def descriptions_table(spark) -> DataFrame:
    schema = T.StructType([T.StructField("strategy", T.StringType()), T.StructField("description", T.StringType())])
    return spark.createDataFrame(STRATEGY_DESCRIPTIONS, schema)


def with_descriptions(signals: DataFrame) -> DataFrame:
    """Left join of a long signal table with the fixed 24-row description table.

    The dimension is a constant of 24 rows, so broadcasting it is size-safe."""
    dim = descriptions_table(signals.sparkSession)
    return signals.join(F.broadcast(dim), "strategy", "left").withColumn(
        "description", F.coalesce(F.col("description"), F.lit(DEFAULT_DESCRIPTION))
    )
