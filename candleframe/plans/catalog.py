"""Registered queries: key -> (Spark builder, DuckDB oracle SQL or None).

Every query reads the driver's tables (bars come from ``events``), so its work grows
with the data. Doubles are rounded to 6 places on both sides for the comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.feature_sets import FEATURE_SETS
from ..functions.indicators import features
from ..operators.bars import fixture_bars
from ..operators.series import drop_layout
from ..sources.tables import events_as_ticks
from . import oracle_sql as Q

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    build: Builder
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[key] = Entry(fn, sql)
        return fn

    return deco


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_bars(events_as_ticks(spark, sf_dir), "1 hour")


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits).alias(name or (c if isinstance(c, str) else "value"))


# ---------------------------------------------------------------------------
# 2.1 bars


@register(
    "fixture_bars",
    f"WITH {Q.BARS_1H} SELECT symbol, ts, {Q.r6('open', 'open')}, {Q.r6('high', 'high')}, "
    f"{Q.r6('low', 'low')}, {Q.r6('close', 'close')}, {Q.r6('volume', 'volume')} FROM bars",
)
def q_fixture_bars(spark, sf_dir):
    b = bars_1h(spark, sf_dir)
    return b.select("symbol", "ts", *[r6(c) for c in ("open", "high", "low", "close", "volume")])


@register(
    "resample_bars",
    f"WITH {Q.BARS_1H}, d AS (SELECT symbol, time_bucket(INTERVAL 1 DAY, ts) AS ts, "
    "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, "
    "sum(volume) AS volume, count(*) AS n_bars FROM bars GROUP BY ALL) "
    f"SELECT symbol, ts, {Q.r6('open', 'open')}, {Q.r6('high', 'high')}, {Q.r6('low', 'low')}, "
    f"{Q.r6('close', 'close')}, {Q.r6('volume', 'volume')}, n_bars FROM d",
)
def q_resample_bars(spark, sf_dir):
    from ..operators.bars import resample_bars

    d = resample_bars(bars_1h(spark, sf_dir), "1 day")
    return d.select("symbol", "ts", *[r6(c) for c in ("open", "high", "low", "close", "volume")], "n_bars")


# ---------------------------------------------------------------------------
# 2.4 rolling-window indicators (W1 stage)

W1_KEYS: dict[str, list[str]] = {
    "sma": ["sma_5", "sma_10", "sma_20", "sma_50"],
    "volume_sma": ["volume_sma", "volume_std", "volume_ratio"],
    "rsi_simple": ["rsi_simple"],
    "bollinger": ["bb_upper", "bb_mid", "bb_lower"],
    "bb_width": ["bb_width", "bb_width_close"],
    "bb_pct": ["bb_pct"],
    "true_range": ["true_range"],
    "atr_simple": ["atr_simple"],
    "dmi_simple": ["dmi_plus", "dmi_minus"],
    "cci": ["cci"],
    "dpo": ["dpo"],
    "ichimoku": ["ichimoku_a", "ichimoku_b"],
    "vortex": ["vortex_pos", "vortex_neg"],
    "donchian_width": ["donchian_width"],
    "keltner": ["keltner_upper", "keltner_lower", "keltner_width"],
    "stoch": ["stoch_k", "stoch_d"],
    "williams_r": ["williams_r"],
    "ultimate_osc": ["ultimate_osc"],
    "awesome_osc": ["ao"],
    "roc": ["roc"],
    "ease_of_movement": ["ease_of_movement"],
    "mfi": ["mfi"],
    "vwap_rolling": ["vwap_rolling"],
    "cmf_aroon": ["cmf", "aroon_osc"],
    "pivot_mean": ["pivot_mean"],
    "returns": ["returns", "log_returns"],
    "volatility": ["volatility"],
    "price_acceleration": ["price_acceleration"],
    "range_pct": ["range_pct"],
    "price_transforms": ["hlc3", "ohlc4", "high_low_ratio", "close_open_ratio"],
    "candle_shape": ["price_position", "hl_intensity", "trend_intensity"],
    "volume_intensity": ["volume_intensity"],
    "volume_change": ["volume_change"],
    "support_resistance": ["support_20", "support_50", "resistance_20", "resistance_50"],
    "candle_patterns": ["candle_engulfing", "candle_doji", "candle_morning_star", "candle_evening_star"],
    "chart_patterns": ["double_top", "double_bottom"],
    "fib_pivots": ["fib_pivot", "fib_r1", "fib_r2", "fib_r3", "fib_s1", "fib_s2", "fib_s3"],
}
INT_COLS = {"candle_engulfing", "candle_doji", "candle_morning_star", "candle_evening_star", "double_top", "double_bottom"}

W1_SQL_CTES = [Q.BARS_1H, Q.W1A]


# Columns whose magnitude (~1e9) leaves fewer than 6 exact decimals in a double.
DIGITS = {"ease_of_movement": 2}


def _sel_sql(c: str, table: dict) -> str:
    if c in INT_COLS:
        return f"CAST({table.get(c, c)} AS INTEGER) AS {c}"
    return Q.r6(table.get(c, c), c, DIGITS.get(c, 6))


def _sel_spark(c: str) -> Column:
    return F.col(c).cast("int").alias(c) if c in INT_COLS else r6(c, digits=DIGITS.get(c, 6))


def _w1_sql(cols: list[str]) -> str:
    sel = ", ".join(_sel_sql(c, Q.W1_DERIVED) for c in cols)
    return f"{Q.with_ctes(*W1_SQL_CTES)} SELECT symbol, ts, {sel} FROM w1"


def _indicator_builder(cols: list[str]) -> Builder:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = features(bars_1h(spark, sf_dir), cols)
        return drop_layout(f).select("symbol", "ts", *[_sel_spark(c) for c in cols])

    return build


for _key, _cols in W1_KEYS.items():
    register(_key, _w1_sql(_cols))(_indicator_builder(_cols))


# ---------------------------------------------------------------------------
# 2.4 recursive indicators (scan stages)

R_KEYS: dict[str, list[str]] = {
    "ema": ["ema_5", "ema_10", "ema_12", "ema_13", "ema_20", "ema_26", "ema_50", "ema_200"],
    "volume_ema": ["volume_ema"],
    "rsi_wilder": ["rsi_wilder"],
    "macd": ["macd", "macd_signal"],
    "macd_hist": ["macd_hist"],
    "atr": ["atr"],
    "adx": ["adx", "plus_di", "minus_di", "dx"],
    "mass_index": ["mass_index"],
    "trix": ["trix"],
    "stoch_rsi": ["stoch_rsi"],
    "kama": ["kama"],
    "ppo": ["ppo"],
    "pvo": ["pvo"],
    "force_index": ["force_index"],
    "vpt": ["vpt"],
    "obv": ["obv"],
    "vwap_cum": ["vwap_cum"],
    "volatility_norm": ["volatility_norm"],
}
DIGITS |= {"force_index": 4, "vpt": 4, "obv": 4}


def _full_sql(cols: list[str]) -> str:
    sel = ", ".join(Q.r6(Q.F_DERIVED.get(c, c), c, DIGITS.get(c, 6)) for c in cols)
    return f"{Q.with_ctes(*Q.FULL_CTES)} SELECT symbol, ts, {sel} FROM f"


for _key, _cols in R_KEYS.items():
    register(_key, _full_sql(_cols))(_indicator_builder(_cols))


# ---------------------------------------------------------------------------
# 2.5 / 2.6 / 2.7 signals and states

from ..functions import signals as SG  # noqa: E402


def _features_for(spark, sf_dir, cols: list[str]) -> DataFrame:
    return drop_layout(features(bars_1h(spark, sf_dir), cols))


def _sig_builder(name: str, buy: str, sell: str | None) -> Builder:
    def build(spark, sf_dir):
        f = _features_for(spark, sf_dir, SG.referenced_columns(buy, sell))
        return SG.with_strategy_signals(f, [name]).select("symbol", "ts", F.col(f"sig_{name}").alias("signal"))

    return build


for _n, _b, _s in SG.STRATEGY_RULES:
    register(
        f"sig_{_n}",
        f"{Q.with_ctes(*Q.FD_CTES)} SELECT symbol, ts, CAST({SG.rule_case(_b, _s)} AS INTEGER) AS signal FROM fd",
    )(_sig_builder(_n, _b, _s))

_ALL_SIGS = ", ".join(f"CAST({SG.rule_case(b, s)} AS INTEGER) AS sig_{n}" for n, b, s in SG.STRATEGY_RULES)
_SUM_SIGS = " + ".join(f"sig_{n}" for n, _, _ in SG.STRATEGY_RULES)
_STRAT_SQL = (
    f"{Q.with_ctes(*Q.FD_CTES)}, s AS (SELECT symbol, ts, {_ALL_SIGS} FROM fd), "
    f"c AS (SELECT *, CAST({_SUM_SIGS} AS DOUBLE) / {float(len(SG.STRATEGY_RULES))} AS combined_signal FROM s)"
)


def _strategy_frame(spark, sf_dir) -> DataFrame:
    return SG.with_strategy_signals(_features_for(spark, sf_dir, SG.strategy_columns()))


@register(
    "combined_signal",
    f"{_STRAT_SQL} SELECT symbol, ts, {Q.r6('combined_signal', 'combined_signal')}, "
    "CASE WHEN combined_signal > 0.2 THEN 'Uptrend' WHEN combined_signal < -0.2 THEN 'Downtrend' "
    "ELSE 'Sideways' END AS market_direction FROM c",
)
def q_combined_signal(spark, sf_dir):
    s = _strategy_frame(spark, sf_dir)
    return s.select("symbol", "ts", r6("combined_signal"), "market_direction")


@register(
    "market_direction",
    f"{_STRAT_SQL} SELECT symbol, CASE WHEN combined_signal > 0.2 THEN 'Uptrend' WHEN combined_signal < -0.2 "
    "THEN 'Downtrend' ELSE 'Sideways' END AS market_direction, count(*) AS n_bars FROM c GROUP BY ALL",
)
def q_market_direction(spark, sf_dir):
    s = _strategy_frame(spark, sf_dir)
    return s.groupBy("symbol", "market_direction").agg(F.count(F.lit(1)).alias("n_bars"))


_DESC_VALUES = ", ".join(
    "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in SG.STRATEGY_DESCRIPTIONS
)


@register(
    "strategy_description",
    f"{_STRAT_SQL}, d(strategy, description) AS (VALUES {_DESC_VALUES}), "
    "l AS (UNPIVOT s ON COLUMNS('^sig_') INTO NAME strategy VALUE signal) "
    "SELECT symbol, ts, substr(l.strategy, 5) AS strategy, CAST(signal AS INTEGER) AS signal, "
    f"coalesce(d.description, '{SG.DEFAULT_DESCRIPTION}') AS description "
    "FROM l LEFT JOIN d ON substr(l.strategy, 5) = d.strategy",
)
def q_strategy_description(spark, sf_dir):
    s = _strategy_frame(spark, sf_dir)
    return SG.with_descriptions(SG.signals_long(s, ["symbol", "ts"])).select(
        "symbol", "ts", "strategy", "signal", "description"
    )


def _paired_builder(name: str, bull: str, bear: str) -> Builder:
    def build(spark, sf_dir):
        f = _features_for(spark, sf_dir, SG.referenced_columns(bull, bear))
        bb, br, sig = SG.paired_case(bull, bear)
        return f.select("symbol", "ts", F.expr(bb).alias("bullish"), F.expr(br).alias("bearish"), F.expr(sig).alias("rule_signal"))

    return build


for _n, _bu, _be in SG.PAIRED_RULES:
    _bb, _br, _sg = SG.paired_case(_bu, _be)
    register(
        f"strat_{SG.slug(_n)}",
        f"{Q.with_ctes(*Q.FD_CTES)} SELECT symbol, ts, {_bb} AS bullish, {_br} AS bearish, {_sg} AS rule_signal FROM fd",
    )(_paired_builder(_n, _bu, _be))


@register(
    "market_state",
    f"{Q.with_ctes(*Q.FD_CTES)}, m AS (SELECT symbol, ts, CAST({SG.MARKET_STATE_SQL} AS INTEGER) AS trend_score FROM fd) "
    "SELECT symbol, ts, trend_score, CASE WHEN trend_score >= 2 THEN 'uptrend' WHEN trend_score <= -2 "
    "THEN 'downtrend' ELSE 'sideways' END AS market_state FROM m",
)
def q_market_state(spark, sf_dir):
    f = _features_for(spark, sf_dir, SG.referenced_columns(SG.MARKET_STATE_SQL))
    return SG.with_market_state(f).select("symbol", "ts", "trend_score", "market_state")


# ---------------------------------------------------------------------------
# Flagship: bars -> sma/bollinger/rsi_simple -> bb/rsi signals -> latest row per symbol

from ..operators.clean import latest_row  # noqa: E402

_FLAG_COLS = ["sma_20", "bb_upper", "bb_lower", "rsi_simple"]


@register(
    "flagship_latest_signals",
    f"{Q.with_ctes(*W1_SQL_CTES)}, s AS (SELECT symbol, ts, close, {Q.W1_DERIVED['bb_upper']} AS bb_upper, "
    f"{Q.W1_DERIVED['bb_lower']} AS bb_lower, sma_20, {Q.W1_DERIVED['rsi_simple']} AS rsi_simple FROM w1), "
    "g AS (SELECT *, CASE WHEN close < bb_lower THEN 1 WHEN close > bb_upper THEN -1 ELSE 0 END AS bb_signal, "
    "CASE WHEN rsi_simple < 30 THEN 1 WHEN rsi_simple > 70 THEN -1 ELSE 0 END AS rsi_signal, "
    "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM s) "
    f"SELECT symbol, ts, {Q.r6('close', 'close')}, {Q.r6('sma_20', 'sma_20')}, {Q.r6('bb_upper', 'bb_upper')}, "
    f"{Q.r6('bb_lower', 'bb_lower')}, {Q.r6('rsi_simple', 'rsi_simple')}, CAST(bb_signal AS INTEGER) AS bb_signal, "
    "CAST(rsi_signal AS INTEGER) AS rsi_signal FROM g WHERE k = 1",
)
def q_flagship(spark, sf_dir):
    f = _features_for(spark, sf_dir, _FLAG_COLS)
    s = f.select(
        "symbol",
        "ts",
        "close",
        *_FLAG_COLS,
        F.expr(SG.rule_case("close < bb_lower", "close > bb_upper")).cast("int").alias("bb_signal"),
        F.expr(SG.rule_case("rsi_simple < 30", "rsi_simple > 70")).cast("int").alias("rsi_signal"),
    )
    last = latest_row(s, by=["symbol"], ts="ts")
    return last.select("symbol", "ts", *[r6(c) for c in ["close", *_FLAG_COLS]], "bb_signal", "rsi_signal")


# ---------------------------------------------------------------------------
# 2.2 validation / cleaning / row selection

from ..operators import aggregates as AG  # noqa: E402
from ..operators import clean as CL  # noqa: E402
from ..operators.joins import join_small  # noqa: E402
from ..operators.series import Layout, index_rows, numbered  # noqa: E402


def raw_candles(spark, sf_dir) -> DataFrame:
    """Stand-in for an uploaded candle file: mixed-case header, epoch milliseconds and
    text-typed numbers, one file per symbol concatenated (schema only; no cleaning)."""
    b = bars_1h(spark, sf_dir)
    return b.select(
        F.col("symbol").alias("Symbol"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("Timestamp"),
        *[F.col(c).cast("string").alias(c.upper()) for c in ("open", "high", "low", "close", "volume")],
    )


@register(
    "clean_candles",
    f"WITH {Q.BARS_1H}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) "
    f"SELECT symbol, ts, {Q.r6('open', 'open')}, {Q.r6('high', 'high')}, {Q.r6('low', 'low')}, "
    f"{Q.r6('close', 'close')}, {Q.r6('volume', 'volume')} FROM n WHERE n >= 100",
)
def q_clean_candles(spark, sf_dir):
    df = CL.lower_columns(raw_candles(spark, sf_dir))
    df = CL.require_columns(df, ["timestamp", "open", "high", "low", "close", "volume"])
    df = CL.coerce_numeric(df)
    df = CL.epoch_ms_to_s(df, "timestamp")
    df = CL.epoch_to_datetime(df, "timestamp", "ts")
    df = CL.drop_null_rows(df)
    df = CL.min_rows_gate(df, 100)
    return CL.select_ohlcv(df).select("symbol", "ts", *[r6(c) for c in CL.OHLCV])


@register(
    "null_report",
    f"WITH {Q.BARS_1H} SELECT symbol, count(*) AS n_rows, "
    + ", ".join(f"count_if({c} IS NULL) AS null_{c}" for c in ("open", "high", "low", "close", "volume"))
    + " FROM bars GROUP BY symbol",
)
def q_null_report(spark, sf_dir):
    df = CL.coerce_numeric(CL.lower_columns(raw_candles(spark, sf_dir)))
    return CL.null_report(df)


@register(
    "tail_n",
    f"WITH {Q.BARS_1H}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) "
    f"SELECT symbol, ts, {Q.r6('close', 'close')} FROM n WHERE k <= 100",
)
def q_tail_n(spark, sf_dir):
    return CL.tail_n(bars_1h(spark, sf_dir), 100).select("symbol", "ts", r6("close"))


@register(
    "drop_last_n",
    f"WITH {Q.BARS_1H}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) "
    f"SELECT symbol, ts, {Q.r6('close', 'close')} FROM n WHERE k > 3",
)
def q_drop_last_n(spark, sf_dir):
    return CL.drop_last_n(bars_1h(spark, sf_dir), 3).select("symbol", "ts", r6("close"))


@register(
    "latest_row",
    f"WITH {Q.BARS_1H} SELECT symbol, max(ts) AS ts, {Q.r6('arg_max(close, ts)', 'close')}, "
    f"{Q.r6('arg_max(volume, ts)', 'volume')} FROM bars GROUP BY symbol",
)
def q_latest_row(spark, sf_dir):
    last = CL.latest_row(bars_1h(spark, sf_dir).select("symbol", "ts", "close", "volume"))
    return last.select("symbol", "ts", r6("close"), r6("volume"))


_FILL_COLS = ["sma_50", "rsi_simple", "volatility"]
_FILL_SQL = ", ".join(
    f"{Q.r6(f'coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), '
             f'first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', c)}"
    for c in _FILL_COLS
)


@register(
    "ffill_bfill",
    f"{Q.with_ctes(*W1_SQL_CTES)}, d AS (SELECT symbol, ts, sma_50, {Q.W1_DERIVED['rsi_simple']} AS rsi_simple, volatility FROM w1) "
    f"SELECT symbol, ts, {_FILL_SQL} FROM d",
)
def q_ffill_bfill(spark, sf_dir):
    f = features(bars_1h(spark, sf_dir), _FILL_COLS).select("symbol", "ts", "_rn", "_blk", "_bs", *_FILL_COLS)
    filled = CL.ffill(f, _FILL_COLS, Layout(), backfill=True)
    return filled.select("symbol", "ts", *[r6(c) for c in _FILL_COLS])


# ---------------------------------------------------------------------------
# 2.8 per-series aggregates

_B = f"WITH {Q.BARS_1H}"


@register(
    "pressure_range",
    f"{_B}, g AS (SELECT symbol, sum((close - low) * volume) / sum(volume) AS b, sum((high - close) * volume) / sum(volume) AS s "
    f"FROM bars GROUP BY symbol) SELECT symbol, {Q.r6('b / (b + s)', 'buying_pressure')}, "
    f"{Q.r6('s / (b + s)', 'selling_pressure')}, {Q.r6('b / (b + s) - s / (b + s)', 'net_pressure')} FROM g",
)
def q_pressure_range(spark, sf_dir):
    p = AG.pressure_range(bars_1h(spark, sf_dir))
    return p.select("symbol", *[r6(c) for c in ("buying_pressure", "selling_pressure", "net_pressure")])


@register(
    "pressure_body",
    f"{_B}, g AS (SELECT symbol, sum(CASE WHEN close > open THEN volume ELSE 0.0 END) AS bv, "
    "sum(CASE WHEN close < open THEN volume ELSE 0.0 END) AS sv, avg(CASE WHEN close > open THEN volume END) AS bva, "
    "avg(CASE WHEN close < open THEN volume END) AS sva FROM bars GROUP BY symbol) "
    f"SELECT symbol, {Q.r6('bv / (bv + sv)', 'buying_pressure')}, {Q.r6('sv / (bv + sv)', 'selling_pressure')}, "
    f"{Q.r6('(bv - sv) / (bv + sv)', 'pressure_ratio')}, {Q.r6('bva', 'buying_volume_avg')}, {Q.r6('sva', 'selling_volume_avg')} FROM g",
)
def q_pressure_body(spark, sf_dir):
    p = AG.pressure_body(bars_1h(spark, sf_dir))
    return p.select(
        "symbol",
        *[r6(c) for c in ("buying_pressure", "selling_pressure", "pressure_ratio", "buying_volume_avg", "selling_volume_avg")],
    )


@register(
    "money_flow",
    f"{_B} SELECT symbol, {Q.r6('sum((high + low + close) / 3.0 * volume)', 'net_money_flow', 2)} FROM bars GROUP BY symbol",
)
def q_money_flow(spark, sf_dir):
    return AG.money_flow(bars_1h(spark, sf_dir)).select("symbol", r6("net_money_flow", digits=2))


_TAIL = "count(*) OVER (PARTITION BY symbol) - rn AS back"


@register(
    "volume_metrics",
    f"{Q.with_ctes(*W1_SQL_CTES)}, t AS (SELECT *, {_TAIL} FROM w1), g AS (SELECT symbol, avg(volume) AS av, "
    "avg(volume_change) AS mc, avg(CASE WHEN back <= 20 THEN volume END) AS ta, "
    f"arg_max({Q.div('volume_std', 'volume_sma')}, rn) AS vv FROM t GROUP BY symbol) "
    f"SELECT symbol, {Q.r6('av', 'average_volume')}, CASE WHEN mc > 0 THEN 'increasing' ELSE 'decreasing' END AS volume_trend, "
    f"{Q.r6('ta / av', 'volume_strength')}, {Q.r6('vv', 'volume_volatility')} FROM g",
)
def q_volume_metrics(spark, sf_dir):
    f = features(bars_1h(spark, sf_dir), ["volume_change", "volume_std", "volume_sma"])
    m = AG.volume_metrics(f)
    return m.select("symbol", r6("average_volume"), "volume_trend", r6("volume_strength"), r6("volume_volatility"))


@register(
    "volume_vs_100",
    f"{_B}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars), "
    "g AS (SELECT symbol, avg(volume) AS av, arg_max(volume, ts) AS lv FROM t WHERE k <= 100 GROUP BY symbol) "
    f"SELECT symbol, {Q.r6('av', 'avg_volume')}, CASE WHEN lv > av THEN 'increasing' ELSE 'decreasing' END AS volume_trend, "
    f"{Q.r6('lv / av', 'volume_strength')} FROM g",
)
def q_volume_vs_100(spark, sf_dir):
    f = numbered(bars_1h(spark, sf_dir))
    m = AG.volume_vs_100(f)
    return m.select("symbol", r6("avg_volume"), "volume_trend", r6("volume_strength"))


@register(
    "trend_metrics",
    f"{Q.with_ctes(*W1_SQL_CTES)}, t AS (SELECT *, {_TAIL} FROM w1), g AS (SELECT symbol, avg(returns) AS pm, "
    f"stddev_samp({Q.div('high', 'low')}) AS vol, avg(CASE WHEN back <= 20 THEN close END) / avg(close) AS ts_, "
    "avg(delta_close) AS pv, avg(delta_close - prev_delta_close) AS pa FROM t GROUP BY symbol) "
    f"SELECT symbol, {Q.r6('pm', 'price_momentum')}, {Q.r6('vol', 'volatility')}, {Q.r6('ts_', 'trend_strength')}, "
    f"{Q.r6('pv', 'price_velocity')}, {Q.r6('pa', 'price_acceleration')} FROM g",
)
def q_trend_metrics(spark, sf_dir):
    f = features(bars_1h(spark, sf_dir), ["returns", "delta_close", "prev_delta_close"])
    m = AG.trend_metrics(f)
    return m.select(
        "symbol", *[r6(c) for c in ("price_momentum", "volatility", "trend_strength", "price_velocity", "price_acceleration")]
    )


@register(
    "total_change",
    f"{_B} SELECT symbol, {Q.r6('arg_max(close, ts)', 'latest_price')}, "
    f"{Q.r6('(arg_max(close, ts) / arg_min(close, ts) - 1.0) * 100.0', 'price_change_pct')} FROM bars GROUP BY symbol",
)
def q_total_change(spark, sf_dir):
    t = AG.total_change(bars_1h(spark, sf_dir))
    return t.select("symbol", r6("latest_price"), r6("price_change_pct"))


@register(
    "median_sq_return",
    f"{Q.with_ctes(*W1_SQL_CTES)} SELECT symbol, {Q.r6('median(returns * returns)', 'median_sq_return')} FROM w1 GROUP BY symbol",
)
def q_median_sq_return(spark, sf_dir):
    f = features(bars_1h(spark, sf_dir), ["returns"])
    return AG.median_sq_return(f).select("symbol", r6("median_sq_return"))


@register(
    "volatility_hl",
    f"{_B} SELECT symbol, {Q.r6('stddev_samp(high / low)', 'volatility_hl')} FROM bars GROUP BY symbol",
)
def q_volatility_hl(spark, sf_dir):
    b = bars_1h(spark, sf_dir)
    return b.groupBy("symbol").agg(F.stddev_samp(F.try_divide(F.col("high"), F.col("low"))).alias("v")).select(
        "symbol", r6("v", "volatility_hl")
    )


_SNAP = ["close", "returns", "rsi", "volatility", "support_20", "support_50", "resistance_20", "resistance_50",
         "sma_20", "sma_50", "prev_close"]


@register(
    "summary_stats",
    f"{Q.with_ctes(*Q.FD_CTES)}, l AS (SELECT * FROM fd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) "
    f"SELECT symbol, {Q.r6('close', 'last_price')}, {Q.r6('returns * 100.0', 'last_return_pct')}, {Q.r6('rsi', 'last_rsi')}, "
    f"{Q.r6('volatility * 100.0', 'volatility_pct')}, {Q.r6('(close / prev_close - 1.0) * 100.0', 'last_change_pct')}, "
    f"{Q.r6('support_20', 'support_20')}, {Q.r6('support_50', 'support_50')}, {Q.r6('resistance_20', 'resistance_20')}, "
    f"{Q.r6('resistance_50', 'resistance_50')}, "
    "CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 'strong_uptrend' WHEN close < sma_20 AND sma_20 < sma_50 THEN 'strong_downtrend' "
    "WHEN sma_20 > sma_50 AND close < sma_20 THEN 'weak_uptrend' WHEN sma_20 < sma_50 AND close > sma_20 THEN 'weak_downtrend' "
    "ELSE 'sideways' END AS market_phase FROM l",
)
def q_summary_stats(spark, sf_dir):
    f = features(bars_1h(spark, sf_dir), _SNAP)
    s = AG.latest_snapshot(f, _SNAP)
    return s.select(
        "symbol",
        r6("close", "last_price"),
        r6(F.col("returns") * 100.0, "last_return_pct"),
        r6("rsi", "last_rsi"),
        r6(F.col("volatility") * 100.0, "volatility_pct"),
        r6((F.try_divide(F.col("close"), F.col("prev_close")) - 1.0) * 100.0, "last_change_pct"),
        *[r6(c) for c in ("support_20", "support_50", "resistance_20", "resistance_50")],
        AG.market_phase_col(F.col("close"), F.col("sma_20"), F.col("sma_50")).alias("market_phase"),
    )


# ---------------------------------------------------------------------------
# 2.12 predictions and consensus

from ..operators import consensus as CS  # noqa: E402


def _predictions(spark, sf_dir) -> DataFrame:
    f = features(bars_1h(spark, sf_dir), SG.strategy_columns() + ["delta_close"])
    return CS.strategy_predictions(SG.with_strategy_signals(f))


def _rule_votes(spark, sf_dir, *carry: str) -> DataFrame:
    """The rules' votes, one row for each bar."""
    f = features(bars_1h(spark, sf_dir), list(dict.fromkeys([*SG.strategy_columns(), "delta_close", *carry])))
    return CS.strategy_votes(SG.with_strategy_signals(f), carry=carry)


_PRED_SQL = (
    f"{Q.with_ctes(*Q.FD_CTES)}, s AS (SELECT symbol, ts, delta_close, {_ALL_SIGS} FROM fd), "
    "l AS (SELECT symbol, ts, delta_close, substr(strategy, 5) AS model, CAST(signal AS INTEGER) AS signal "
    "FROM (UNPIVOT s ON COLUMNS('^sig_') INTO NAME strategy VALUE signal)), "
    "h AS (SELECT *, CASE WHEN lag(signal) OVER (PARTITION BY symbol, model ORDER BY ts) IS NULL "
    "OR lag(signal) OVER (PARTITION BY symbol, model ORDER BY ts) = 0 THEN NULL "
    "WHEN CAST(sign(delta_close) AS INTEGER) = lag(signal) OVER (PARTITION BY symbol, model ORDER BY ts) THEN 1.0 ELSE 0.0 END AS hit FROM l), "
    "a AS (SELECT *, avg(hit) OVER (PARTITION BY symbol, model ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS accuracy FROM h), "
    "p0 AS (SELECT *, CASE WHEN signal = 1 THEN coalesce(accuracy, 0.5) WHEN signal = -1 THEN 1.0 - coalesce(accuracy, 0.5) ELSE 0.5 END AS prob_up FROM a), "
    "p AS (SELECT symbol, ts, model, signal, prob_up, 1.0 - prob_up AS prob_down, greatest(prob_up, 1.0 - prob_up) AS confidence, "
    "CASE WHEN prob_up > 0.7 THEN 'strong_uptrend' WHEN prob_up > 0.55 THEN 'weak_uptrend' WHEN prob_up < 0.3 THEN 'strong_downtrend' "
    "WHEN prob_up < 0.45 THEN 'weak_downtrend' ELSE 'sideways' END AS trend, accuracy, accuracy AS f1 FROM p0)"
)


@register(
    "strategy_predictions",
    f"{_PRED_SQL} SELECT symbol, ts, model, signal, {Q.r6('prob_up', 'prob_up')}, {Q.r6('prob_down', 'prob_down')}, "
    f"{Q.r6('confidence', 'confidence')}, trend, {Q.r6('accuracy', 'accuracy')}, {Q.r6('f1', 'f1')} FROM p",
)
def q_strategy_predictions(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return p.select("symbol", "ts", "model", "signal", *[r6(c) for c in ("prob_up", "prob_down", "confidence")], "trend",
                    r6("accuracy"), r6("f1"))


@register(
    "ensemble_sign",
    f"{_PRED_SQL}, g AS (SELECT symbol, ts, CAST(sign(sum(signal)) AS INTEGER) AS ev, count(*) AS n, avg(confidence ORDER BY model) AS mc, "
    "count_if(signal = 1) AS u, count_if(signal = 0) AS z, count_if(signal = -1) AS d FROM p GROUP BY ALL) "
    "SELECT symbol, ts, ev AS ensemble_vote, "
    f"{Q.r6('CAST(CASE WHEN ev = 1 THEN u WHEN ev = -1 THEN d ELSE z END AS DOUBLE) / n', 'model_agreement')}, "
    f"{Q.r6('mc', 'mean_confidence')}, CASE WHEN ev = 1 THEN 'Uptrend' WHEN ev = -1 THEN 'Downtrend' ELSE 'Sideways' END AS market_direction, "
    f"{Q.r6(Q.div('fd.atr', 'fd.close'), 'volatility_level')}, {Q.r6('fd.adx', 'trend_strength')} FROM g JOIN fd USING (symbol, ts)",
)
def q_ensemble_sign(spark, sf_dir):
    """The rules' signs summed, with the volatility level (ATR over close) and the trend strength (ADX) of the bar."""
    e = CS.ensemble_sign(_rule_votes(spark, sf_dir, "close", "atr", "adx"), ["symbol", "ts", "close", "atr", "adx"])
    e = e.withColumns({"volatility_level": F.try_divide("atr", "close"), "trend_strength": F.col("adx")})
    return e.select("symbol", "ts", "ensemble_vote", r6("model_agreement"), r6("mean_confidence"), "market_direction", r6("volatility_level"), r6("trend_strength"))


_TW = " ".join(f"WHEN trend = '{t}' THEN {w}" for t, w in CS.TREND_WEIGHTS.items())


@register(
    "consensus_weighted",
    f"{_PRED_SQL}, g AS (SELECT symbol, ts, sum((CASE {_TW} END) * confidence ORDER BY model) / sum(confidence ORDER BY model) AS score FROM p GROUP BY ALL) "
    f"SELECT symbol, ts, {Q.r6('score', 'score')}, CASE WHEN score > 1 THEN 'strong_uptrend' WHEN score > 0.2 THEN 'weak_uptrend' "
    "WHEN score < -1 THEN 'strong_downtrend' WHEN score < -0.2 THEN 'weak_downtrend' ELSE 'sideways' END AS consensus FROM g",
)
def q_consensus_weighted(spark, sf_dir):
    c = CS.consensus_weighted(_rule_votes(spark, sf_dir))
    return c.select("symbol", "ts", r6("score"), "consensus")


_T_ORDER = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(CS.TRENDS))
_DIST_SQL = (
    f"{_PRED_SQL}, c AS (SELECT symbol, ts, trend, count(*) AS votes, sum(confidence ORDER BY model) / count(*) AS conf, sum(confidence ORDER BY model) AS sconf, "
    "string_agg(model, ',' ORDER BY model) AS models FROM p GROUP BY ALL), n AS (SELECT symbol, ts, count(*) AS n_models FROM p GROUP BY ALL), "
    f"r AS (SELECT c.*, row_number() OVER (PARTITION BY symbol, ts ORDER BY votes DESC, conf DESC, CASE trend {_T_ORDER} END) AS k1, "
    f"row_number() OVER (PARTITION BY symbol, ts ORDER BY votes DESC, sconf DESC, CASE trend {_T_ORDER} END) AS k2, "
    "max(conf) OVER (PARTITION BY symbol, ts) AS hc FROM c)"
)


@register(
    "combined_predictions",
    f"{_DIST_SQL} SELECT n.symbol, n.ts, n.n_models, "
    + ", ".join(
        f"CAST(coalesce(max(CASE WHEN trend = '{t}' THEN votes END), 0) AS BIGINT) AS {t}_votes, "
        f"{Q.r6(f'coalesce(max(CASE WHEN trend = {chr(39)}{t}{chr(39)} THEN conf END), 0.0)', f'{t}_confidence')}, "
        f"{Q.r6(f'coalesce(max(CASE WHEN trend = {chr(39)}{t}{chr(39)} THEN votes END), 0) * 100.0 / n.n_models', f'{t}_pct')}"
        for t in CS.TRENDS
    )
    + ", max(CASE WHEN k1 = 1 THEN trend END) AS dominant_trend, string_agg(trend, ',' ORDER BY k1) AS ranked_trends, "
    + ", ".join(f"coalesce(max(CASE WHEN trend = '{t}' THEN models END), '') AS {t}_models" for t in CS.TRENDS)
    + f", {Q.r6('max(hc)', 'highest_confidence')} FROM n JOIN r ON n.symbol = r.symbol AND n.ts = r.ts GROUP BY n.symbol, n.ts, n.n_models",
)
def q_combined_predictions(spark, sf_dir):
    d = CS.trend_distribution(_rule_votes(spark, sf_dir))
    cols = ["symbol", "ts", "n_models"]
    for t in CS.TRENDS:
        cols += [F.col(f"{t}_votes"), r6(f"{t}_confidence"), r6(f"{t}_pct"), f"{t}_models"]
    return d.select(*cols, "dominant_trend", "ranked_trends", r6("highest_confidence"))


@register(
    "consensus_votes",
    f"{_DIST_SQL} SELECT r.symbol, r.ts, trend, {Q.r6('conf', 'confidence')}, {Q.r6('CAST(votes AS DOUBLE) / n_models', 'agreement')}, "
    "CASE WHEN CAST(votes AS DOUBLE) / n_models >= 0.7 THEN 'strong' WHEN CAST(votes AS DOUBLE) / n_models >= 0.5 THEN 'moderate' "
    "ELSE 'weak' END AS agreement_level, CAST(0 AS BIGINT) AS other_votes FROM r JOIN n ON n.symbol = r.symbol AND n.ts = r.ts WHERE k2 = 1",
)
def q_consensus_votes(spark, sf_dir):
    v = CS.consensus_votes(_rule_votes(spark, sf_dir))
    return v.select("symbol", "ts", "trend", r6("confidence"), r6("agreement"), "agreement_level", F.col("other_votes").cast("long").alias("other_votes"))


@register(
    "consensus_mode",
    f"{_PRED_SQL}, c AS (SELECT symbol, ts, trend, count(*) AS votes FROM p GROUP BY ALL), "
    "m AS (SELECT symbol, ts, trend FROM c QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY votes DESC, trend) = 1), "
    "av AS (SELECT symbol, ts, sum(confidence ORDER BY model) / count(*) AS mc, sum(prob_up ORDER BY model) / count(*) AS mp FROM p GROUP BY ALL) "
    f"SELECT m.symbol, m.ts, m.trend, {Q.r6('mc', 'mean_confidence')}, {Q.r6('mp', 'mean_prob_up')} FROM m JOIN av USING (symbol, ts)",
)
def q_consensus_mode(spark, sf_dir):
    m = CS.consensus_mode(_rule_votes(spark, sf_dir))
    return m.select("symbol", "ts", "trend", r6("mean_confidence"), r6("mean_prob_up"))


@register(
    "mean_confidence",
    f"{_PRED_SQL} SELECT symbol, {Q.r6('avg(confidence)', 'mean_confidence')}, "
    "CASE WHEN avg(confidence) > 0.8 THEN 'high' WHEN avg(confidence) > 0.6 THEN 'medium' ELSE 'low' END AS confidence_bucket "
    "FROM p GROUP BY symbol",
)
def q_mean_confidence(spark, sf_dir):
    g = _predictions(spark, sf_dir).groupBy("symbol").agg(F.avg("confidence").alias("mean_confidence"))
    return g.select("symbol", r6("mean_confidence"), CS.confidence_bucket(F.col("mean_confidence")).alias("confidence_bucket"))


# ---------------------------------------------------------------------------
# 2.7 context classifiers

from ..functions import context as CX  # noqa: E402

_CTX_SQL = {
    "trend_context": "CASE WHEN close > sma_10 AND sma_10 > sma_20 AND sma_20 > sma_50 AND "
    f"{Q.div('close - close_lag5', 'close_lag4')} * 100.0 > 0.5 THEN 'strong_uptrend' "
    "WHEN close < sma_10 AND sma_10 < sma_20 AND sma_20 < sma_50 AND "
    f"{Q.div('close - close_lag5', 'close_lag4')} * 100.0 < -0.5 THEN 'strong_downtrend' "
    f"WHEN close > sma_20 AND {Q.div('close - close_lag5', 'close_lag4')} * 100.0 > 0 THEN 'uptrend' "
    f"WHEN close < sma_20 AND {Q.div('close - close_lag5', 'close_lag4')} * 100.0 < 0 THEN 'downtrend' ELSE 'neutral' END",
    "volume_context": f"coalesce(volume_sma_5 > volume_sma AND {Q.div('volume', 'volume_sma')} > 1.5, false)",
    "rsi_context": "CASE WHEN rsi_simple < 30 AND coalesce(close > prev_close, false) THEN 'strong_buy' "
    "WHEN rsi_simple > 70 AND NOT coalesce(close > prev_close, false) THEN 'strong_sell' "
    "WHEN rsi_simple < 40 THEN 'buy' WHEN rsi_simple > 60 THEN 'sell' ELSE 'neutral' END",
    "recent_trend": "CASE WHEN coalesce(ema_5 > prev_ema_5, false) AND coalesce(ema_20 > prev_ema_20, false) THEN 'up' "
    "WHEN NOT coalesce(ema_5 > prev_ema_5, false) AND NOT coalesce(ema_20 > prev_ema_20, false) THEN 'down' END",
    "volume_confirmed": "coalesce(volume_ratio > 1.0, false)",
    "rsi_signal": "CASE WHEN rsi < 30 THEN 'up' WHEN rsi > 70 THEN 'down' END",
    "market_phase": "CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 'strong_uptrend' WHEN close < sma_20 AND sma_20 < sma_50 "
    "THEN 'strong_downtrend' WHEN sma_20 > sma_50 AND close < sma_20 THEN 'weak_uptrend' WHEN sma_20 < sma_50 AND close > sma_20 "
    "THEN 'weak_downtrend' ELSE 'sideways' END",
    "volatility_band": "CASE WHEN volatility_norm > 50 THEN 'high' WHEN volatility_norm > 30 THEN 'medium' ELSE 'low' END",
    "volume_band": "CASE WHEN volume_ratio > 1.5 THEN 'high' WHEN volume_ratio < 0.5 THEN 'low' ELSE 'normal' END",
    "trend_band": "CASE WHEN adx > 25 THEN 'strong' ELSE 'weak' END",
}
_CTX_KEYS = {
    "trend_context": ["trend_context"],
    "volume_context": ["volume_context"],
    "rsi_context": ["rsi_context"],
    "recent_trend": ["recent_trend"],
    "volume_confirmed_rsi_extreme": ["volume_confirmed", "rsi_signal"],
    "market_phase": ["market_phase"],
    "ui_bands": ["volatility_band", "volume_band", "trend_band"],
}


def _ctx_builder(cols):
    def build(spark, sf_dir):
        f = _features_for(spark, sf_dir, list(dict.fromkeys(c for out in cols for c in CX.CONTEXT_INPUTS[out])))
        return CX.with_context(f, cols).select("symbol", "ts", *cols)

    return build


for _k, _cols in _CTX_KEYS.items():
    register(
        _k,
        f"{Q.with_ctes(*Q.FD_CTES)} SELECT symbol, ts, " + ", ".join(f"{_CTX_SQL[c]} AS {c}" for c in _cols) + " FROM fd",
    )(_ctx_builder(_cols))


# ---------------------------------------------------------------------------
# 2.11 labels, splits, scalers

from ..operators import labels as LB  # noqa: E402

_LBL_SQL = (
    f"{Q.with_ctes(*W1_SQL_CTES)}, x AS (SELECT symbol, ts, rn, close, returns, "
    "lead(close, 1) OVER (PARTITION BY symbol ORDER BY ts) AS l1, lead(close, 3) OVER (PARTITION BY symbol ORDER BY ts) AS l3, "
    "lead(close, 10) OVER (PARTITION BY symbol ORDER BY ts) AS l10, lead(returns, 1) OVER (PARTITION BY symbol ORDER BY ts) AS nr FROM w1)"
)


@register(
    "label_fwd_k",
    f"{_LBL_SQL} SELECT symbol, ts, CAST(l1 > close AS INTEGER) AS label_up_1, CAST(l3 > close AS INTEGER) AS label_up_3, "
    "CAST(l10 > close AS INTEGER) AS label_up_10 FROM x",
)
def q_label_fwd_k(spark, sf_dir):
    f = LB.forward_labels(features(bars_1h(spark, sf_dir), ["returns"]))
    return f.select("symbol", "ts", "label_up_1", "label_up_3", "label_up_10")


@register(
    "label_fwd_k_reference_mode",
    f"{_LBL_SQL} SELECT symbol, ts, coalesce(CAST(l1 > close AS INTEGER), 0) AS label_up_1, "
    "coalesce(CAST(l10 > close AS INTEGER), 0) AS label_up_10 FROM x",
)
def q_label_fwd_k_ref(spark, sf_dir):
    f = LB.forward_labels(features(bars_1h(spark, sf_dir), ["returns"]), reference_mode=True)
    return f.select("symbol", "ts", "label_up_1", "label_up_10")


@register(
    "label_3way",
    f"{_LBL_SQL} SELECT symbol, ts, CAST(CASE WHEN {Q.div('l3', 'close')} - 1.0 > 0.001 THEN 1 "
    f"WHEN {Q.div('l3', 'close')} - 1.0 < -0.001 THEN -1 WHEN {Q.div('l3', 'close')} IS NOT NULL THEN 0 END AS INTEGER) AS label_3way FROM x",
)
def q_label_3way(spark, sf_dir):
    f = LB.forward_labels(features(bars_1h(spark, sf_dir), ["returns"]))
    return f.select("symbol", "ts", "label_3way")


@register(
    "label_next_return",
    f"{_LBL_SQL} SELECT symbol, ts, {Q.r6('nr', 'next_return')} FROM x",
)
def q_label_next_return(spark, sf_dir):
    f = LB.forward_labels(features(bars_1h(spark, sf_dir), ["returns"]))
    return f.select("symbol", "ts", r6("next_return"))


@register(
    "split_chrono",
    f"WITH {Q.BARS_1H}, x AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, "
    "count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, ts, rn >= floor(n * 0.8) AS is_test FROM x",
)
def q_split_chrono(spark, sf_dir):
    f = LB.split_chrono(numbered(bars_1h(spark, sf_dir)))
    return f.select("symbol", "ts", "is_test")


@register(
    "split_time_series",
    f"WITH {Q.BARS_1H}, x AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, "
    "count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, ts, rn >= n - least(20, floor(n / 5)) AS is_test FROM x",
)
def q_split_time_series(spark, sf_dir):
    f = LB.split_time_series(numbered(bars_1h(spark, sf_dir)))
    return f.select("symbol", "ts", "is_test")


_SCALE_COLS = ["rsi_simple", "volatility", "volume_ratio"]
_SCALE_BASE = (
    f"{Q.with_ctes(*W1_SQL_CTES)}, x AS (SELECT symbol, ts, {Q.W1_DERIVED['rsi_simple']} AS rsi_simple, volatility, "
    f"{Q.W1_DERIVED['volume_ratio']} AS volume_ratio, rn >= floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS is_test FROM w1)"
)


@register(
    "scale_standard",
    f"{_SCALE_BASE}, s AS (SELECT symbol, "
    + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in _SCALE_COLS)
    + " FROM x WHERE NOT is_test GROUP BY symbol) SELECT x.symbol, ts, "
    + ", ".join(Q.r6(Q.div(f"{c} - mu_{c}", f"sd_{c}"), f"{c}_z") for c in _SCALE_COLS)
    + " FROM x JOIN s ON x.symbol = s.symbol",
)
def q_scale_standard(spark, sf_dir):
    f = LB.split_chrono(features(bars_1h(spark, sf_dir), _SCALE_COLS))
    z = LB.scale_standard(f, _SCALE_COLS)
    return z.select("symbol", "ts", *[r6(f"{c}_z") for c in _SCALE_COLS])


@register(
    "scale_robust",
    f"{_SCALE_BASE}, s AS (SELECT symbol, "
    + ", ".join(
        f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS q2_{c}, quantile_cont({c}, 0.75) AS q3_{c}"
        for c in _SCALE_COLS
    )
    + " FROM x WHERE NOT is_test GROUP BY symbol) SELECT x.symbol, ts, "
    + ", ".join(Q.r6(Q.div(f"{c} - q2_{c}", f"q3_{c} - q1_{c}"), f"{c}_r") for c in _SCALE_COLS)
    + " FROM x JOIN s ON x.symbol = s.symbol",
)
def q_scale_robust(spark, sf_dir):
    f = LB.split_chrono(features(bars_1h(spark, sf_dir), _SCALE_COLS))
    z = LB.scale_robust(f, _SCALE_COLS)
    return z.select("symbol", "ts", *[r6(f"{c}_r") for c in _SCALE_COLS])


# ---------------------------------------------------------------------------
# 2.6 rule/model merge and sentiment (rule-only path is SQL-checkable)


def _paired_rules(spark, sf_dir) -> DataFrame:
    f = _features_for(spark, sf_dir, SG.paired_columns())
    return SG.paired_long(f, ["symbol", "ts"])


_PAIRED_SQL = (
    f"{Q.with_ctes(*Q.FD_CTES)}, pr AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, ts, '{n}' AS strategy, {SG.paired_case(b, e)[0]} AS bullish, {SG.paired_case(b, e)[1]} AS bearish FROM fd"
        for n, b, e in SG.PAIRED_RULES
    )
    + "), m AS (SELECT *, CASE WHEN bullish AND NOT bearish THEN 'bullish' WHEN bearish AND NOT bullish THEN 'bearish' "
    "ELSE 'neutral' END AS signal FROM pr)"
)


@register(
    "sentiment_score",
    f"{_PAIRED_SQL}, g AS (SELECT symbol, ts, sum(CASE signal WHEN 'strong_bullish' THEN 2 WHEN 'bullish' THEN 1 "
    "WHEN 'bearish' THEN -1 WHEN 'strong_bearish' THEN -2 ELSE 0 END) / 20.0 AS s, "
    "count_if(signal = 'strong_bullish') AS n_strong_bullish, count_if(signal = 'bullish') AS n_bullish, "
    "count_if(signal = 'neutral') AS n_neutral, count_if(signal = 'bearish') AS n_bearish, "
    "count_if(signal = 'strong_bearish') AS n_strong_bearish FROM m GROUP BY ALL) "
    f"SELECT symbol, ts, {Q.r6('s', 'sentiment_score')}, n_strong_bullish, n_bullish, n_neutral, n_bearish, n_strong_bearish, "
    "CASE WHEN s > 0.6 THEN 'strong_uptrend' WHEN s > 0.2 THEN 'uptrend' WHEN s < -0.6 THEN 'strong_downtrend' "
    "WHEN s < -0.2 THEN 'downtrend' ELSE 'sideways' END AS overall_sentiment FROM g",
)
def q_sentiment_score(spark, sf_dir):
    merged = CS.strategy_ml_merge(_paired_rules(spark, sf_dir), None)
    s = CS.sentiment(merged, len(SG.PAIRED_RULES))
    return s.select("symbol", "ts", r6("sentiment_score"), *[f"n_{k}" for k in CS.SIGNAL_WEIGHTS], "overall_sentiment")


@register(
    "signal_counts",
    f"{_PAIRED_SQL} SELECT symbol, signal, count(*) AS n FROM m GROUP BY ALL",
)
def q_signal_counts(spark, sf_dir):
    merged = CS.strategy_ml_merge(_paired_rules(spark, sf_dir), None)
    return merged.groupBy("symbol", "signal").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# 2.10 ranking / top-k, 2.9 joins over predictions


@register(
    "rank_models",
    f"{_PRED_SQL} SELECT symbol, ts, model, {Q.r6('(coalesce(accuracy, 0.0) + coalesce(f1, 0.0)) / 2.0', 'performance')}, "
    "row_number() OVER (PARTITION BY symbol, ts ORDER BY (coalesce(accuracy, 0.0) + coalesce(f1, 0.0)) / 2.0 DESC, "
    "accuracy DESC NULLS LAST, model) AS rank FROM p",
)
def q_rank_models(spark, sf_dir):
    r = CS.rank_models(_rule_votes(spark, sf_dir))
    return r.select("symbol", "ts", "model", r6("performance"), F.col("rank"))


@register(
    "top3_per_trend",
    f"{_PRED_SQL} SELECT symbol, ts, trend, model, {Q.r6('confidence', 'confidence')}, trend_rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY symbol, ts, trend ORDER BY confidence DESC, model) AS trend_rank FROM p) "
    "WHERE trend_rank <= 3",
)
def q_top3_per_trend(spark, sf_dir):
    t = CS.top_k_per_trend(_rule_votes(spark, sf_dir), 3)
    return t.select("symbol", "ts", "trend", "model", r6("confidence"), "trend_rank")


@register(
    "incomplete_model_filter",
    f"{_PRED_SQL} SELECT symbol, ts, model, {Q.r6('accuracy', 'accuracy')} FROM p WHERE accuracy IS NOT NULL AND f1 IS NOT NULL",
)
def q_incomplete_model_filter(spark, sf_dir):
    p = _predictions(spark, sf_dir).na.drop(subset=["accuracy", "f1"])
    return p.select("symbol", "ts", "model", r6("accuracy"))


def registry_table(spark) -> DataFrame:
    from ..operators.registry import base_registry

    return base_registry(spark)


from ..operators.registry import BASE_MODELS  # noqa: E402

_REG_VALUES = ", ".join("('{}', '{}', '{}', '{}')".format(*[x.replace("'", "''") for x in r]) for r in BASE_MODELS)
_REG_SQL = (
    f"{_PRED_SQL}, base(model, name, type, description) AS (VALUES {_REG_VALUES}), "
    f"d(strategy, description) AS (VALUES {_DESC_VALUES}), "
    "nm AS (SELECT DISTINCT model FROM p WHERE model NOT IN (SELECT model FROM base)), "
    "reg AS (SELECT * FROM base UNION ALL SELECT nm.model, nm.model AS name, 'rule_strategy' AS type, "
    f"coalesce(d.description, '{SG.DEFAULT_DESCRIPTION}') AS description FROM nm LEFT JOIN d ON nm.model = d.strategy)"
)


@register("registry_add", f"{_REG_SQL} SELECT model, name, type, description FROM reg")
def q_registry_add(spark, sf_dir):
    from ..operators.registry import register_models

    return register_models(registry_table(spark), _predictions(spark, sf_dir).select("model"))


@register(
    "join_registry",
    f"{_REG_SQL} SELECT p.symbol, p.ts, p.model, reg.name, reg.type, p.trend, {Q.r6('p.confidence', 'confidence')} "
    "FROM p JOIN reg ON p.model = reg.model",
)
def q_join_registry(spark, sf_dir):
    from ..operators.registry import register_models

    preds = _predictions(spark, sf_dir)
    reg = register_models(registry_table(spark), preds.select("model").distinct())
    return preds.join(reg, "model", "inner").select("symbol", "ts", "model", "name", "type", "trend", r6("confidence"))


@register(
    "align_series",
    f"{Q.with_ctes(*Q.FD_CTES)} SELECT symbol, ts, {Q.r6('sma_20', 'sma_20')}, {Q.r6('ema_20', 'ema_20')}, "
    f"{Q.r6('sma_20 - ema_20', 'sma_ema_gap')} FROM fd",
)
def q_align_series(spark, sf_dir):
    b = numbered(bars_1h(spark, sf_dir))  # the two series to align share the numbered bars
    a = drop_layout(features(b, ["sma_20"], indexed=True)).select("symbol", "ts", "sma_20")
    e = drop_layout(features(b, ["ema_20"], indexed=True)).select("symbol", "ts", "ema_20")
    j = a.join(e, ["symbol", "ts"], "inner")
    return j.select("symbol", "ts", r6("sma_20"), r6("ema_20"), r6(F.col("sma_20") - F.col("ema_20"), "sma_ema_gap"))


@register(
    "softmax_argmax",
    f"{_PRED_SQL}, v AS (SELECT symbol, ts, count_if(signal = -1) AS d, count_if(signal = 0) AS z, count_if(signal = 1) AS u "
    "FROM p GROUP BY ALL), e AS (SELECT *, greatest(d, z, u) AS mx FROM v), "
    "sm AS (SELECT *, exp(d - mx) + exp(z - mx) + exp(u - mx) AS t FROM e) "
    f"SELECT symbol, ts, {Q.r6('exp(d - mx) / t', 'p_bearish')}, {Q.r6('exp(z - mx) / t', 'p_neutral')}, "
    f"{Q.r6('exp(u - mx) / t', 'p_bullish')}, CASE WHEN d = mx THEN 'bearish' WHEN z = mx THEN 'neutral' ELSE 'bullish' END AS label "
    "FROM sm",
)
def q_softmax_argmax(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    v = p.groupBy("symbol", "ts").agg(
        F.array(
            F.count_if(F.col("signal") == -1).cast("double"),
            F.count_if(F.col("signal") == 0).cast("double"),
            F.count_if(F.col("signal") == 1).cast("double"),
        ).alias("logits")
    )
    s = CS.softmax_argmax(v, ["bearish", "neutral", "bullish"])
    return s.select(
        "symbol", "ts", r6(F.col("probs")[0], "p_bearish"), r6(F.col("probs")[1], "p_neutral"), r6(F.col("probs")[2], "p_bullish"), "label"
    )


# ---------------------------------------------------------------------------
# 2.11 / 2.12 MLlib bake-off (rows-only checks: model output has no SQL oracle)

from ..operators import ml as ML  # noqa: E402

_ML_MEMO: dict = {}


def _bakeoff(spark, sf_dir):
    """Panel + fitted models, memoised per (session, sf_dir) so the ML queries below share
    one fit (fits are seeded and deterministic)."""
    key = (id(spark._jsparkSession), sf_dir)
    if key not in _ML_MEMO:
        p = ML.panel(bars_1h(spark, sf_dir))
        preds, fitted = ML.bakeoff(p)
        preds = preds.unionByName(ML.discriminant(p, quadratic=False)).unionByName(ML.discriminant(p, quadratic=True))
        _ML_MEMO[key] = (p, preds, fitted)
    return _ML_MEMO[key]


@register("model_bakeoff", None)
def q_model_bakeoff(spark, sf_dir):
    _, preds, _ = _bakeoff(spark, sf_dir)
    return preds.select("symbol", "ts", "model", r6("prob_up"), "prediction", "label")


@register("eval_metrics", None)
def q_eval_metrics(spark, sf_dir):
    _, preds, _ = _bakeoff(spark, sf_dir)
    m = ML.eval_metrics(preds)
    return m.select("model", *[r6(c) for c in ("accuracy", "precision", "recall", "f1", "f1_weighted")], "n_test")


@register("feature_importance", None)
def q_feature_importance(spark, sf_dir):
    _, _, fitted = _bakeoff(spark, sf_dir)
    return ML.feature_importance(spark, fitted, ML.FEATURES_12)


@register("top20_importance", None)
def q_top20_importance(spark, sf_dir):
    _, _, fitted = _bakeoff(spark, sf_dir)
    return ML.top_importance(ML.feature_importance(spark, fitted, ML.FEATURES_12), 20)


@register("voting_soft_hard", None)
def q_voting(spark, sf_dir):
    _, preds, _ = _bakeoff(spark, sf_dir)
    return ML.voting(preds)


@register("score_rows", None)
def q_score_rows(spark, sf_dir):
    """Latest scored bar per (symbol, model): up/down probability."""
    _, preds, _ = _bakeoff(spark, sf_dir)
    last = preds.groupBy("symbol", "model").agg(F.max_by(F.struct("ts", "prob_up"), F.col("ts")).alias("_l"))
    return last.select("symbol", "model", "_l.ts", r6(F.col("_l.prob_up"), "prob_up"), r6(1.0 - F.col("_l.prob_up"), "prob_down"))


@register("ml_decision", None)
def q_ml_decision(spark, sf_dir):
    """Weighted ensemble probability over the bake-off (models with a reference weight),
    then the decision rule with market context of the same bar."""
    _, preds, _ = _bakeoff(spark, sf_dir)
    ens = CS.ensemble_prob(ML.with_eval(preds), ML.weights_table(spark))
    ctx = CX.with_context(_features_for(spark, sf_dir, [*dict.fromkeys(c for cs in CX.CONTEXT_INPUTS.values() for c in cs), "volatility"]), list(CX.CONTEXT_INPUTS)).select(
        "symbol", "ts", "volatility", "recent_trend", "rsi_signal", "volume_confirmed"
    )
    d = CS.decision(ens, ctx)
    return d.select("symbol", "ts", r6("up_probability"), r6("down_probability"), r6("confidence_level"), "decision")


@register("stacking", None)
def q_stacking(spark, sf_dir):
    """Stacked ensemble (RF, GBT, logistic base models; logistic meta-model) on the panel."""
    p, _, _ = _bakeoff(spark, sf_dir)
    return ML.stacking(p).select("symbol", "ts", "model", r6("prob_up"), "prediction", "label")


@register("up_down_label", None)
def q_up_down_label(spark, sf_dir):
    _, preds, _ = _bakeoff(spark, sf_dir)
    return CS.up_down_label(preds).select("symbol", "ts", "model", "prediction")


@register("tune_random_search", None)
def q_tune_random_search(spark, sf_dir):
    p, _, _ = _bakeoff(spark, sf_dir)
    return ML.tune_random_search(p)


@register("reg_random_forest_gbt", None)
def q_regressors(spark, sf_dir):
    p, _, _ = _bakeoff(spark, sf_dir)
    return ML.regress_next_return(p)


@register("strategy_ml_merge", None)
def q_strategy_ml_merge(spark, sf_dir):
    """Paired rule signals merged with a model vote per strategy: a GBT fit per strategy on
    its feature set (one panel fit over all symbols each), scored on the test rows."""
    rules = _paired_rules(spark, sf_dir)
    p = ML.panel(bars_1h(spark, sf_dir), sorted({c for cols in FEATURE_SETS.values() for c in cols}))

    def vote(name):
        spec = ML.ModelSpec("gbt", lambda d: ML.GBTClassifier(labelCol="label", maxIter=20, maxDepth=3, seed=42))
        pr, _ = ML.bakeoff(p, FEATURE_SETS[name], [spec])
        return pr.select(
            "symbol", "ts", F.lit(name).alias("strategy"),
            F.when(F.col("prob_up") > 0.5, "bullish").otherwise("bearish").alias("prediction"),
            F.greatest(F.col("prob_up"), 1.0 - F.col("prob_up")).alias("confidence"),
        )

    votes = ML.side_by_side(spark, vote, list(FEATURE_SETS))
    mv = votes[0]
    for v in votes[1:]:
        mv = mv.unionByName(v)
    merged = CS.strategy_ml_merge(rules, mv)
    return merged.select("symbol", "ts", "strategy", "bullish", "bearish", "prediction", r6("confidence"), "signal")


# ---------------------------------------------------------------------------
# 2.13 Structured Streaming (run with an availableNow trigger over the files present)

from ..streaming import bars as ST  # noqa: E402

_WM_SQL = "(SELECT max(ts) FROM events) - INTERVAL 2 HOUR"


@register(
    "stream_bars",
    f"WITH {Q.BARS_1H} SELECT symbol, ts, {Q.r6('open', 'open')}, {Q.r6('high', 'high')}, {Q.r6('low', 'low')}, "
    f"{Q.r6('close', 'close')}, {Q.r6('volume', 'volume')} FROM bars WHERE ts + INTERVAL 1 HOUR <= {_WM_SQL}",
)
def q_stream_bars(spark, sf_dir):
    b = ST.run_available(ST.stream_bars(ST.tick_stream(spark, sf_dir), "1 hour"), "stream_bars")
    return b.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[r6(c) for c in ("open", "high", "low", "close", "volume")])


@register(
    "stream_bars_sliding",
    "WITH w AS (SELECT event_type AS symbol, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * k) MINUTE AS ws, ts, event_id, value "
    "FROM events, (VALUES (0), (1)) AS t(k)) "
    f"SELECT symbol, ws AS ts, {Q.r6('arg_min(value, (ts, event_id))', 'open')}, {Q.r6('max(value)', 'high')}, "
    f"{Q.r6('min(value)', 'low')}, {Q.r6('arg_max(value, (ts, event_id))', 'close')}, {Q.r6('sum(value)', 'volume')} "
    f"FROM w GROUP BY symbol, ws HAVING ws + INTERVAL 1 HOUR <= {_WM_SQL}",
)
def q_stream_bars_sliding(spark, sf_dir):
    b = ST.run_available(ST.stream_bars(ST.tick_stream(spark, sf_dir), "1 hour", "30 minutes"), "stream_bars_sliding")
    return b.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[r6(c) for c in ("open", "high", "low", "close", "volume")])


def _stream_ema(spark, sf_dir):
    import uuid as _uuid

    from ..session import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(spark)}/bars-{_uuid.uuid4().hex[:8]}"
    ST.write_stream_parquet(ST.stream_bars(ST.tick_stream(spark, sf_dir), "1 hour"), "bars_sink", folder)
    ema = ST.stream_ema(ST.bar_stream(spark, folder), span=20)
    return ema, folder


_EMA_ALPHA = 2.0 / 21
_EMA_SQL = (
    f"WITH RECURSIVE {Q.BARS_1H}, cb AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn "
    f"FROM bars WHERE ts + INTERVAL 1 HOUR <= {_WM_SQL}), "
    "r AS (SELECT symbol, rn, ts, close, close AS y FROM cb WHERE rn = 0 UNION ALL "
    f"SELECT c.symbol, c.rn, c.ts, c.close, {1.0 - _EMA_ALPHA!r} * r.y + {_EMA_ALPHA!r} * c.close FROM r JOIN cb c "
    "ON c.symbol = r.symbol AND c.rn = r.rn + 1)"
)


@register(
    "stream_ema",
    f"{_EMA_SQL} SELECT symbol, ts, {Q.r6('close', 'close')}, {Q.r6('CASE WHEN rn >= 19 THEN y END', 'ema')} FROM r",
)
def q_stream_ema(spark, sf_dir):
    ema, _ = _stream_ema(spark, sf_dir)
    out = ST.run_available(ema, "stream_ema")
    return out.filter(~F.col("late")).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("close"), r6("ema"))


@register(
    "stream_alerts",
    f"{_EMA_SQL}, s AS (SELECT symbol, ts, sign(close - y) AS side FROM r WHERE rn >= 19), "
    "l AS (SELECT *, lag(side) OVER (PARTITION BY symbol ORDER BY ts) AS prev_side FROM s) "
    "SELECT symbol, ts, CAST(side AS DOUBLE) AS side, CAST(prev_side AS DOUBLE) AS prev_side FROM l "
    "WHERE prev_side IS NOT NULL AND prev_side <> side",
)
def q_stream_alerts(spark, sf_dir):
    ema, folder = _stream_ema(spark, sf_dir)
    alerts = ST.run_alerts(ema, f"{folder}-alerts")
    a = spark.read.parquet(alerts)
    return a.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("side").cast("double"), F.col("prev_side").cast("double"))


# ---------------------------------------------------------------------------
# 2.12 / 2.13 forecasts, timestamps, text

from ..functions import reports as RP  # noqa: E402
from ..operators.clean import tail_n  # noqa: E402


def _drift_latest(spark, sf_dir) -> DataFrame:
    """Latest bar per symbol with a drift = mean return of the last 20 bars and the
    20-bar return volatility."""
    f = features(bars_1h(spark, sf_dir), ["returns", "volatility"])
    t = tail_n(f, 20)
    drift = t.groupBy("symbol").agg(F.avg("returns").alias("drift"))
    last = AG.latest_snapshot(f, ["ts", "close", "volatility"])
    return last.join(drift, "symbol")


_DRIFT_SQL = (
    f"{Q.with_ctes(*W1_SQL_CTES)}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM w1), "
    "d AS (SELECT symbol, avg(returns) AS drift FROM t WHERE k <= 20 GROUP BY symbol), "
    "l AS (SELECT t.symbol, ts, close, volatility, drift FROM t JOIN d ON t.symbol = d.symbol WHERE k = 1)"
)


@register(
    "forecast_compound",
    f"{_DRIFT_SQL}, s AS (SELECT l.*, step FROM l, range(1, 11) AS r(step)) "
    "SELECT symbol, CAST(step AS INTEGER) AS step, strftime(ts + step * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS date, "
    "printf('%.10e', close * pow(1.0 + drift, step)) AS forecast, "
    "printf('%.10e', close * pow(1.0 + drift + volatility, step)) AS upper_bound, "
    "printf('%.10e', close * pow(1.0 + drift - volatility, step)) AS lower_bound FROM s",
)
def q_forecast_compound(spark, sf_dir):
    """Compounded drift forecast; values (which grow geometrically) are reported with 11
    significant digits."""
    fc = RP.forecast_compound(_drift_latest(spark, sf_dir), "drift", "volatility")
    return fc.select(
        "symbol", "step", "date", *[F.format_string("%.10e", F.col(c)).alias(c) for c in ("forecast", "upper_bound", "lower_bound")]
    )


@register(
    "next_timestamp",
    f"WITH {Q.BARS_1H} SELECT symbol, strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS next_timestamp FROM bars GROUP BY symbol",
)
def q_next_timestamp(spark, sf_dir):
    last = CL.latest_row(bars_1h(spark, sf_dir).select("symbol", "ts"))
    return RP.next_timestamp(last)


@register(
    "format_trend",
    f"{_PRED_SQL}, c AS (SELECT DISTINCT symbol, trend FROM p) SELECT symbol, trend, "
    "list_aggregate(list_transform(string_split(regexp_replace(trend, '_', ' '), ' '), "
    "lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS label FROM c",
)
def q_format_trend(spark, sf_dir):
    c = _predictions(spark, sf_dir).select("symbol", "trend").distinct()
    return c.select("symbol", "trend", RP.format_trend(F.col("trend")).alias("label"))


@register(
    "format_datetime",
    f"WITH {Q.BARS_1H} SELECT symbol, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM bars",
)
def q_format_datetime(spark, sf_dir):
    b = bars_1h(spark, sf_dir)
    return b.select("symbol", "ts", RP.format_datetime(F.col("ts")).alias("ts_text"))


@register(
    "describe_market",
    f"{Q.with_ctes(*W1_SQL_CTES)}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM w1), "
    "g AS (SELECT symbol, count(*) AS n, arg_max(close, ts) AS cp, "
    "(arg_max(close, ts) / arg_min(close, ts) - 1.0) * 100.0 AS pc, "
    "CASE WHEN avg(volume_change) > 0 THEN 'increasing' ELSE 'decreasing' END AS vt, "
    "sum(CASE WHEN close > open THEN volume ELSE 0.0 END) AS bv, sum(CASE WHEN close < open THEN volume ELSE 0.0 END) AS sv, "
    "arg_max(sma_20, ts) AS s20, arg_max(sma_50, ts) AS s50 FROM t GROUP BY symbol) "
    "SELECT symbol, printf('%d bars, close %.2f (%.2f%% since the first bar); volume %s; phase %s; "
    "share of volume in rising bars %.2f, in falling bars %.2f', n, cp, pc, vt, "
    "CASE WHEN cp > s20 AND s20 > s50 THEN 'strong_uptrend' WHEN cp < s20 AND s20 < s50 THEN 'strong_downtrend' "
    "WHEN s20 > s50 AND cp < s20 THEN 'weak_uptrend' WHEN s20 < s50 AND cp > s20 THEN 'weak_downtrend' ELSE 'sideways' END, "
    "bv / (bv + sv), sv / (bv + sv)) AS description FROM g",
)
def q_describe_market(spark, sf_dir):
    """Text per symbol over its whole series."""
    f = features(bars_1h(spark, sf_dir), ["sma_20", "sma_50", "volume_change"])
    g = f.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.max_by("close", "ts").alias("current_price"),
        ((F.try_divide(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1.0) * 100.0).alias("price_change"),
        F.avg("volume_change").alias("_mvc"),
        F.sum(F.when(F.col("close") > F.col("open"), F.col("volume")).otherwise(0.0)).alias("_bv"),
        F.sum(F.when(F.col("close") < F.col("open"), F.col("volume")).otherwise(0.0)).alias("_sv"),
        F.max_by("sma_20", "ts").alias("_s20"),
        F.max_by("sma_50", "ts").alias("_s50"),
    )
    stats = g.select(
        "symbol",
        "n_bars",
        "current_price",
        "price_change",
        F.when(F.col("_mvc") > 0, "increasing").otherwise("decreasing").alias("volume_trend"),
        AG.market_phase_col(F.col("current_price"), F.col("_s20"), F.col("_s50")).alias("market_phase"),
        F.try_divide(F.col("_bv"), F.col("_bv") + F.col("_sv")).alias("buying_pressure"),
        F.try_divide(F.col("_sv"), F.col("_bv") + F.col("_sv")).alias("selling_pressure"),
    )
    return RP.describe_market(stats)


# ---------------------------------------------------------------------------
# 2.11 re-aimed forecasters, 2.4 volume profile, 2.12 strategy entries/exits

from ..operators import forecasters as FC  # noqa: E402
from ..operators.forecasters import RISKMETRICS_LAMBDA as RISKMETRICS  # noqa: E402


@register(
    "seasonal_trend_forecast",
    f"WITH {Q.BARS_1H}, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS DOUBLE) AS rn FROM bars), "
    "fit AS (SELECT symbol, regr_slope(close, rn) AS slope, regr_intercept(close, rn) AS intercept, count(*) AS n FROM x GROUP BY symbol), "
    "res AS (SELECT x.symbol, hour(ts) AS hour, close - (intercept + slope * rn) AS resid FROM x JOIN fit USING (symbol)), "
    "se AS (SELECT symbol, hour, avg(resid) AS seasonal FROM res GROUP BY ALL), "
    "l AS (SELECT symbol, max(ts) + INTERVAL 1 HOUR AS next_ts, arg_max(close, ts) AS close FROM bars GROUP BY symbol), "
    "fc AS (SELECT l.symbol, next_ts, slope, intercept + slope * CAST(n AS DOUBLE) + coalesce(seasonal, 0.0) AS forecast, close "
    "FROM l JOIN fit USING (symbol) LEFT JOIN se ON se.symbol = l.symbol AND se.hour = hour(l.next_ts)) "
    f"SELECT symbol, next_ts, {Q.r6('slope', 'slope')}, {Q.r6('forecast', 'forecast')}, "
    "CASE WHEN forecast > close THEN 'up' ELSE 'down' END AS direction FROM fc",
)
def q_seasonal_trend_forecast(spark, sf_dir):
    f = numbered(bars_1h(spark, sf_dir))
    s = FC.seasonal_trend_forecast(f)
    return s.select("symbol", "next_ts", r6("slope"), r6("forecast"), "direction")


@register(
    "ewma_variance_vote",
    f"{Q.with_ctes(*W1_SQL_CTES)}, r AS (SELECT symbol, rn, returns * returns AS v FROM w1 WHERE rn = 1 UNION ALL "
    f"SELECT w.symbol, w.rn, CASE WHEN w.returns IS NULL THEN r.v ELSE {RISKMETRICS!r} * r.v + {1.0 - RISKMETRICS!r} * (w.returns * w.returns) END "
    "FROM r JOIN w1 w ON w.symbol = r.symbol AND w.rn = r.rn + 1), "
    "l AS (SELECT symbol, arg_max(v, rn) AS ewma_var FROM r GROUP BY symbol), "
    "m AS (SELECT symbol, median(returns * returns) AS med FROM w1 GROUP BY symbol) "
    f"SELECT l.symbol, {Q.r6('ewma_var', 'ewma_var')}, {Q.r6('med', 'median_sq_return')}, "
    "CASE WHEN ewma_var > med THEN 'up' ELSE 'down' END AS vote FROM l JOIN m USING (symbol)",
)
def q_ewma_variance_vote(spark, sf_dir):
    f = features(bars_1h(spark, sf_dir), ["returns"])
    v = FC.ewma_variance_vote(f, Layout())
    return v.select("symbol", r6("ewma_var"), r6("median_sq_return"), "vote")


@register(
    "volume_profile",
    f"WITH {Q.BARS_1H}, d AS (SELECT *, date_trunc('day', ts) AS day FROM bars), "
    "r AS (SELECT symbol, day, min(low) AS lo, max(high) AS hi FROM d GROUP BY ALL), "
    "x AS (SELECT d.symbol, d.day, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((close - lo) / (hi - lo) * 10) AS INTEGER), 9) END AS bucket, "
    "volume FROM d JOIN r ON d.symbol = r.symbol AND d.day = r.day) "
    f"SELECT symbol, day, bucket, {Q.r6('sum(volume)', 'volume')}, count(*) AS n_bars FROM x GROUP BY ALL",
)
def q_volume_profile(spark, sf_dir):
    """Volume by price bucket (10 equal buckets of the day's low-high range) per session."""
    b = bars_1h(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    rng = b.groupBy("symbol", "day").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    x = join_small(b, rng, ["symbol", "day"], "inner")
    bucket = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor((F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10).cast("int"), F.lit(9))
    )
    g = x.groupBy("symbol", "day", bucket.alias("bucket")).agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"))
    return g.select("symbol", F.col("day").cast("timestamp_ntz").alias("day"), "bucket", r6("volume"), "n_bars")


@register(
    "combine_strategies",
    f"{_STRAT_SQL}, md AS (SELECT symbol, ts, CASE WHEN combined_signal > 0.2 THEN 'Uptrend' WHEN combined_signal < -0.2 THEN 'Downtrend' "
    "ELSE 'Sideways' END AS d FROM c), ch AS (SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY ts) AS pd FROM md) "
    "SELECT symbol, ts, pd AS prev_direction, d AS market_direction, CASE d WHEN 'Uptrend' THEN 'enter_long' "
    "WHEN 'Downtrend' THEN 'enter_short' ELSE 'exit' END AS action FROM ch WHERE pd IS NOT NULL AND pd <> d",
)
def q_combine_strategies(spark, sf_dir):
    """Entries and exits: bars where the market direction changes."""
    from ..operators.series import windowed

    f = features(bars_1h(spark, sf_dir), SG.strategy_columns())
    s = SG.with_strategy_signals(f).select("symbol", "ts", "_rn", "_blk", "_bs", "market_direction")
    w = windowed(s, Layout(), 1, [[("prev_direction", lambda w: F.lag("market_direction").over(w))]])
    ch = w.filter(F.col("prev_direction").isNotNull() & (F.col("prev_direction") != F.col("market_direction")))
    return ch.select(
        "symbol",
        "ts",
        "prev_direction",
        "market_direction",
        F.when(F.col("market_direction") == "Uptrend", "enter_long")
        .when(F.col("market_direction") == "Downtrend", "enter_short")
        .otherwise("exit")
        .alias("action"),
    )


@register(
    "is_in_registry",
    f"{_REG_SQL} SELECT symbol, ts, model FROM p WHERE model IN (SELECT model FROM reg WHERE type = 'rule_strategy')",
)
def q_is_in_registry(spark, sf_dir):
    from ..operators.registry import register_models

    preds = _predictions(spark, sf_dir)
    reg = register_models(registry_table(spark), preds.select("model")).filter(F.col("type") == "rule_strategy")
    return CL.is_in(preds, reg.select("model"), "model").select("symbol", "ts", "model")


@register("write_records", None)
def q_write_records(spark, sf_dir):
    """Bars as JSON records (one string per row), the shape the reference returns."""
    b = bars_1h(spark, sf_dir)
    return b.select(F.to_json(F.struct("symbol", RP.format_datetime(F.col("ts")).alias("datetime"), "open", "high", "low", "close", "volume")).alias("record"))


# ---------------------------------------------------------------------------
# Votes of the rule strategies as a predictions table: the operators that take model
# predictions, on rows that SQL can make too.

#: The model weights fall to the rules in their order; rules beyond the last model get the least weight.
_VOTE_WEIGHTS = list(zip_longest([n for n, _, _ in SG.STRATEGY_RULES], [w for _, w in ML.MODEL_WEIGHTS], fillvalue=min(w for _, w in ML.MODEL_WEIGHTS)))
_MERGE_MODELS = list(zip([n for n, _, _ in SG.PAIRED_RULES], [n for n, _, _ in SG.STRATEGY_RULES], strict=False))


def _votes(spark, sf_dir) -> DataFrame:
    """Predictions with the next bar's direction as the label; last bars have none and go."""
    from ..operators.series import windowed

    f = features(bars_1h(spark, sf_dir), SG.strategy_columns() + ["delta_close"])
    preds = CS.strategy_predictions(SG.with_strategy_signals(f))
    ahead = windowed(f.select("symbol", "ts", "close", "_rn", "_blk", "_bs"), Layout(), 0, [[("_next", lambda w: F.lead("close").over(w))]], ahead=1)
    labels = ahead.filter(F.col("_next").isNotNull()).select("symbol", "ts", (F.col("_next") > F.col("close")).cast("double").alias("label"))
    return preds.join(labels, ["symbol", "ts"]).withColumns({"prediction": (F.col("prob_up") > 0.5).cast("double"), "has_probability": F.col("signal") != 0})


_VOTES_SQL = (
    f"{_PRED_SQL}, y AS (SELECT symbol, ts, close, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM fd), "
    "v AS (SELECT p.*, CASE WHEN y.nxt > y.close THEN 1 ELSE 0 END AS label, CASE WHEN p.prob_up > 0.5 THEN 1 ELSE 0 END AS prediction "
    "FROM p JOIN y ON y.symbol = p.symbol AND y.ts = p.ts WHERE y.nxt IS NOT NULL)"
)


@register(
    "rule_eval_metrics",
    f"{_VOTES_SQL}, g AS (SELECT model, CAST(count_if(label = 1 AND prediction = 1) AS DOUBLE) AS tp, CAST(count_if(label = 0 AND prediction = 1) AS DOUBLE) AS fp, "
    "CAST(count_if(label = 1 AND prediction = 0) AS DOUBLE) AS fn, CAST(count_if(label = 0 AND prediction = 0) AS DOUBLE) AS tn FROM v GROUP BY model), "
    "r AS (SELECT model, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, "
    "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM g) "
    f"SELECT model, {Q.r6('accuracy', 'accuracy')}, {Q.r6('precision', 'precision')}, {Q.r6('recall', 'recall')}, "
    f"{Q.r6('CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END', 'f1')} FROM r",
)
def q_rule_eval_metrics(spark, sf_dir):
    """Accuracy, precision, recall and f1 of each rule's vote against the next bar."""
    return ML.eval_metrics(_votes(spark, sf_dir)).select("model", *[r6(c) for c in ("accuracy", "precision", "recall", "f1")])


@register(
    "rule_voting",
    f"{_VOTES_SQL} SELECT symbol, ts, {Q.r6('avg(prob_up ORDER BY model) FILTER (WHERE signal <> 0)', 'soft_prob_up')}, "
    "CAST(2 * sum(prediction) > count(*) AS INTEGER) AS hard_vote, count(*) AS n_models FROM v GROUP BY symbol, ts",
)
def q_rule_voting(spark, sf_dir):
    """Soft vote over the rules that speak (a neutral rule has no probability) and hard vote over all."""
    return ML.voting(_votes(spark, sf_dir)).select("symbol", "ts", r6("soft_prob_up"), "hard_vote", "n_models")


# Written apart from the weights above.
_WEIGHTS_SQL = (
    "wt(model, weight) AS (SELECT unnest(['rsi_signal', 'macd_signal', 'bb_signal']), 0.12 UNION ALL SELECT 'ma_cross', 0.1 "
    "UNION ALL SELECT unnest(['vpt_signal', 'adx_signal', 'cci_signal', 'ichimoku_signal']), 0.08 "
    "UNION ALL SELECT unnest(['trix_signal', 'force_index_signal', 'eom_signal']), 0.06 "
    "UNION ALL SELECT unnest(['ao_signal', 'stoch_rsi_signal', 'volatility_breakout', 'momentum_combined', 'kama_cross', 'volume_surge', "
    "'price_channel_breakout', 'triple_ema', 'elder_ray', 'supertrend', 'squeeze_momentum', 'vwap_cross', 'dmi_signal', 'williams_r', "
    "'ultimate_oscillator', 'aroon_oscillator', 'chaikin_money_flow', 'on_balance_volume', 'momentum_quality', 'trend_strength', "
    "'volume_trend_confirm', 'volatility_regime', 'price_momentum', 'trend_reversal']), 0.02)"
)
_ENSEMBLE_SQL = (
    f"{_PRED_SQL}, {_WEIGHTS_SQL}, wn AS (SELECT model, weight / (SELECT sum(weight) FROM wt) AS weight FROM wt), "
    "aw AS (SELECT p.*, wn.weight * (coalesce(p.accuracy, 0.0) + coalesce(p.f1, 0.0)) / 2.0 AS aw FROM p JOIN wn ON wn.model = p.model), "
    "e AS (SELECT symbol, ts, CASE WHEN sum(aw) > 0 THEN sum(prob_up * aw ORDER BY model) / sum(aw ORDER BY model) ELSE 0.0 END AS up FROM aw GROUP BY symbol, ts)"
)


def _ensemble(spark, sf_dir) -> DataFrame:
    return CS.ensemble_prob(_rule_votes(spark, sf_dir), spark.createDataFrame(_VOTE_WEIGHTS, "model string, weight double"))


@register("rule_ensemble_prob", f"{_ENSEMBLE_SQL} SELECT symbol, ts, {Q.r6('up', 'up_probability')}, {Q.r6('1.0 - up', 'down_probability')} FROM e")
def q_rule_ensemble_prob(spark, sf_dir):
    """Probabilities of all 35 rules, weighted by normalised weights and by each rule's hit rate."""
    return _ensemble(spark, sf_dir).select("symbol", "ts", r6("up_probability"), r6("down_probability"))


@register(
    "rule_decision",
    f"{_ENSEMBLE_SQL}, x AS (SELECT symbol, ts, volatility, {_CTX_SQL['recent_trend']} AS rt, {_CTX_SQL['rsi_signal']} AS rs, {_CTX_SQL['volume_confirmed']} AS vc FROM fd), "
    "d AS (SELECT e.symbol, e.ts, e.up, abs(e.up - (1.0 - e.up)) AS c, least(0.05, coalesce(x.volatility, 0.0)) AS adj, "
    "coalesce(x.rt = 'up', false) OR coalesce(x.rs = 'up', false) AS uc, coalesce(x.rt = 'down', false) OR coalesce(x.rs = 'down', false) AS dc, x.vc "
    "FROM e JOIN x ON x.symbol = e.symbol AND x.ts = e.ts) "
    "SELECT symbol, ts, CASE WHEN c >= 0.65 - adj AND up > 1.0 - up THEN CASE WHEN uc AND vc THEN 'STRONG_BUY' ELSE 'BUY' END "
    "WHEN c >= 0.65 - adj THEN CASE WHEN dc AND vc THEN 'STRONG_SELL' ELSE 'SELL' END "
    "WHEN c >= 0.55 - adj AND up > 1.0 - up THEN CASE WHEN uc THEN 'BUY' ELSE 'HOLD' END "
    "WHEN c >= 0.55 - adj THEN CASE WHEN dc THEN 'SELL' ELSE 'HOLD' END ELSE 'HOLD' END AS decision FROM d",
)
def q_rule_decision(spark, sf_dir):
    """The decision rule on the rules' ensemble probability and the context of the same bar."""
    outputs = ("recent_trend", "rsi_signal", "volume_confirmed")
    inputs = [*dict.fromkeys(c for o in outputs for c in CX.CONTEXT_INPUTS[o]), "volatility"]
    ctx = CX.with_context(_features_for(spark, sf_dir, inputs), outputs).select("symbol", "ts", "volatility", *outputs)
    return CS.decision(_ensemble(spark, sf_dir), ctx).select("symbol", "ts", "decision")


@register("rule_up_down_label", f"{_PRED_SQL} SELECT symbol, ts, model, CASE WHEN prob_up > 0.5 THEN 'UP' ELSE 'DOWN' END AS prediction FROM p")
def q_rule_up_down_label(spark, sf_dir):
    return CS.up_down_label(_predictions(spark, sf_dir)).select("symbol", "ts", "model", "prediction")


_MERGE_SQL = (
    f"{_PRED_SQL}, mm(strategy, model) AS (VALUES " + ", ".join(f"('{s}', '{m}')" for s, m in _MERGE_MODELS) + "), "
    + "pr AS (" + " UNION ALL ".join(
        f"SELECT symbol, ts, '{n}' AS strategy, {SG.paired_case(b, e)[0]} AS bullish, {SG.paired_case(b, e)[1]} AS bearish FROM fd"
        for n, b, e in SG.PAIRED_RULES
    ) + "), mv AS (SELECT p.symbol, p.ts, mm.strategy, CASE WHEN p.signal > 0 THEN 'bullish' ELSE 'bearish' END AS prediction "
    "FROM p JOIN mm ON mm.model = p.model WHERE p.signal <> 0), "
    "j AS (SELECT pr.*, mv.prediction FROM pr LEFT JOIN mv ON mv.symbol = pr.symbol AND mv.ts = pr.ts AND mv.strategy = pr.strategy), "
    "mg AS (SELECT symbol, ts, strategy, CASE WHEN prediction IS NULL THEN CASE WHEN bullish AND NOT bearish THEN 'bullish' WHEN bearish AND NOT bullish THEN 'bearish' ELSE 'neutral' END "
    "WHEN bullish AND prediction = 'bullish' THEN 'strong_bullish' WHEN bearish AND prediction = 'bearish' THEN 'strong_bearish' "
    "WHEN bullish OR prediction = 'bullish' THEN 'bullish' WHEN bearish OR prediction = 'bearish' THEN 'bearish' ELSE 'neutral' END AS signal FROM j)"
)


def _merged(spark, sf_dir) -> DataFrame:
    """Paired rules merged with the vote of one rule model for each strategy (a neutral vote is no row)."""
    f = features(bars_1h(spark, sf_dir), list(dict.fromkeys(SG.strategy_columns() + SG.paired_columns() + ["delta_close"])))
    pairs = spark.createDataFrame(_MERGE_MODELS, "strategy string, model string")
    votes = CS.strategy_predictions(SG.with_strategy_signals(f)).filter(F.col("signal") != 0).join(pairs, "model")
    votes = votes.select("symbol", "ts", "strategy", F.when(F.col("signal") > 0, "bullish").otherwise("bearish").alias("prediction"))
    return CS.strategy_ml_merge(SG.paired_long(drop_layout(f), ["symbol", "ts"]), votes)


@register("rule_strategy_merge", f"{_MERGE_SQL} SELECT symbol, ts, strategy, signal FROM mg")
def q_rule_strategy_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("symbol", "ts", "strategy", "signal")


@register(
    "merged_signal_counts",
    f"{_MERGE_SQL} SELECT symbol, ts, count_if(signal = 'strong_bullish') AS n_strong_bullish, count_if(signal = 'bullish') AS n_bullish, "
    "count_if(signal = 'neutral') AS n_neutral, count_if(signal = 'bearish') AS n_bearish, count_if(signal = 'strong_bearish') AS n_strong_bearish, "
    f"{Q.r6(f'''sum(CASE signal WHEN 'strong_bullish' THEN 2 WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 WHEN 'strong_bearish' THEN -2 ELSE 0 END) / {2.0 * len(SG.PAIRED_RULES)}''', 'sentiment_score')} "
    "FROM mg GROUP BY symbol, ts",
)
def q_merged_signal_counts(spark, sf_dir):
    """Counts and sentiment of merged signals, strong ones included."""
    s = CS.sentiment(_merged(spark, sf_dir), len(SG.PAIRED_RULES))
    return s.select("symbol", "ts", *[F.col(f"n_{k}") for k in CS.SIGNAL_WEIGHTS], r6("sentiment_score"))


@register(
    "pressure_momentum",
    f"{Q.with_ctes(*W1_SQL_CTES)}, t AS (SELECT symbol, returns, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM w1) "
    f"SELECT symbol, {Q.r6('CASE WHEN count(returns) = 14 THEN avg(returns) END', 'pressure_momentum')} FROM t WHERE k <= 14 GROUP BY symbol",
)
def q_pressure_momentum(spark, sf_dir):
    """Mean return of the last 14 bars, NULL if one of them has no return."""
    last = tail_n(features(bars_1h(spark, sf_dir), ["returns"]), 14)
    return last.groupBy("symbol").agg(F.when(F.count("returns") == 14, F.round(F.avg("returns"), 6)).alias("pressure_momentum"))


# Modules that register more queries; they take the names above from this one.
from . import ingest, learning, models, streams, validation  # noqa: E402, F401
