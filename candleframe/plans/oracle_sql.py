"""DuckDB SQL for the correctness oracle.

Written independently of the Spark code, from the definitions in SURVEY §2.4: plain
window SQL for rolling/lag work, recursive CTEs for recurrences. Each registered query
has one SQL string; the fragments below are shared text.
"""

from __future__ import annotations

BARS_1H = """
bars AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, sum(value) AS volume
  FROM events GROUP BY ALL
),
b AS (
  SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::BIGINT AS rn,
         (high + low + close) / 3.0 AS tp
  FROM bars
)"""


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {agg}({x}) OVER {frame(n)} END)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def rsi_like(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 AND ({num}) > 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + {div(num, den)}) END)"


# Level 1: lags and rolling over OHLCV
W1A = f"""
w1a AS (
  SELECT *,
    {lag('close')} AS prev_close, {lag('high')} AS prev_high, {lag('low')} AS prev_low,
    {lag('volume')} AS prev_volume, {lag('open')} AS prev_open,
    {lag('close', 2)} AS close_lag2, {lag('open', 2)} AS open_lag2, {lag('high', 2)} AS high_lag2, {lag('low', 2)} AS low_lag2,
    {lag('close', 4)} AS close_lag4, {lag('close', 5)} AS close_lag5,
    {lag('close', 10)} AS close_lag10, {lag('close', 11)} AS close_lag11, {lag('close', 12)} AS close_lag12,
    {lag('tp')} AS prev_tp,
    {roll('avg', 'close', 5)} AS sma_5, {roll('avg', 'close', 10)} AS sma_10,
    {roll('avg', 'close', 20)} AS sma_20, {roll('avg', 'close', 50)} AS sma_50,
    {roll('stddev_pop', 'close', 20)} AS std_pop_20,
    {roll('avg', 'volume', 20)} AS volume_sma, {roll('stddev_samp', 'volume', 20)} AS volume_std,
    {roll('avg', 'volume', 5)} AS volume_sma_5, {roll('avg', 'volume', 10)} AS volume_sma_10,
    {roll('max', 'high', 9)} AS max_high_9, {roll('min', 'low', 9)} AS min_low_9,
    {roll('avg', 'high', 10)} AS high_avg_10, {roll('avg', 'low', 10)} AS low_avg_10,
    {roll('max', 'high', 14)} AS max_high_14, {roll('min', 'low', 14)} AS min_low_14,
    {roll('max', 'high', 20)} AS max_high_20, {roll('min', 'low', 20)} AS min_low_20,
    {roll('max', 'high', 26)} AS max_high_26, {roll('min', 'low', 26)} AS min_low_26,
    {roll('max', 'high', 50)} AS max_high_50, {roll('min', 'low', 50)} AS min_low_50,
    {roll('max', 'high', 52)} AS max_high_52, {roll('min', 'low', 52)} AS min_low_52,
    {roll('avg', '((high + low) / 2.0)', 5)} - {roll('avg', '((high + low) / 2.0)', 34)} AS ao,
    {roll('avg', 'tp', 20)} AS tp_avg_20,
    list(tp) OVER {frame(20)} AS tp_list_20,
    {roll('avg', '((4.0 * high - 2.0 * low + close) / 3.0)', 20)} AS keltner_upper,
    {roll('avg', '((-2.0 * high + 4.0 * low + close) / 3.0)', 20)} AS keltner_lower,
    {div(roll('sum', '(tp * volume)', 14), roll('sum', 'volume', 14))} AS vwap_rolling,
    {div(roll('sum', f"({div('((close - low) - (high - close))', '(high - low)')} * volume)", 20), roll('sum', 'volume', 20))} AS cmf,
    (CASE WHEN count(high) OVER {frame(25)} = 25 THEN -(max({{'v': high, 'r': -rn}}) OVER {frame(25)}).r END) AS aroon_hi_rn,
    (CASE WHEN count(low) OVER {frame(25)} = 25 THEN (min({{'v': low, 'r': rn}}) OVER {frame(25)}).r END) AS aroon_lo_rn
  FROM b
),
w1b AS (
  SELECT *,
    greatest(high - low, coalesce(abs(high - prev_close), high - low), coalesce(abs(low - prev_close), high - low)) AS tr,
    close - prev_close AS delta_close,
    {div('close', 'prev_close')} - 1.0 AS returns,
    {div('volume', 'prev_volume')} - 1.0 AS volume_change,
    close - coalesce(least(low, prev_close), low) AS bp_uo,
    coalesce(greatest(high, prev_close), high) - coalesce(least(low, prev_close), low) AS tr_uo,
    high - prev_high AS up_move, prev_low - low AS down_move,
    sign(tp - prev_tp) AS tp_dir,
    abs(high - prev_low) AS vm_pos, abs(low - prev_high) AS vm_neg,
    (CASE WHEN len(tp_list_20) = 20 THEN list_sum(list_transform(tp_list_20, lambda x: abs(x - tp_avg_20))) / 20.0 END) AS tp_mad_20,
    100.0 * {div('close - min_low_14', 'max_high_14 - min_low_14')} AS stoch_k,
    CASE WHEN prev_high > high_lag2 AND prev_high >= high THEN prev_high END AS swing_high,
    CASE WHEN prev_low < low_lag2 AND prev_low <= low THEN prev_low END AS swing_low
  FROM w1a
),
w1c AS (
  SELECT *,
    CASE WHEN delta_close > 0 THEN delta_close ELSE 0.0 END AS gain,
    CASE WHEN delta_close < 0 THEN -delta_close ELSE 0.0 END AS loss,
    abs(delta_close) AS abs_delta,
    CASE WHEN up_move > down_move AND up_move > 0 THEN up_move ELSE 0.0 END AS pos_dm,
    CASE WHEN down_move > up_move AND down_move > 0 THEN down_move ELSE 0.0 END AS neg_dm,
    {roll('avg', 'tr', 14)} AS tr_avg_14,
    {div(roll('sum', 'vm_pos', 14), roll('sum', 'tr', 14))} AS vortex_pos,
    {div(roll('sum', 'vm_neg', 14), roll('sum', 'tr', 14))} AS vortex_neg,
    {roll('stddev_samp', 'returns', 20)} AS volatility,
    {lag('returns')} AS prev_returns, {lag('delta_close')} AS prev_delta_close,
    100.0 * (4.0 * {div(roll('sum', 'bp_uo', 7), roll('sum', 'tr_uo', 7))}
           + 2.0 * {div(roll('sum', 'bp_uo', 14), roll('sum', 'tr_uo', 14))}
           + {div(roll('sum', 'bp_uo', 28), roll('sum', 'tr_uo', 28))}) / 7.0 AS ultimate_osc,
    {roll('sum', '(CASE WHEN tp_dir > 0 THEN tp * volume ELSE 0.0 END)', 14)} AS mf_pos,
    {roll('sum', '(CASE WHEN tp_dir < 0 THEN tp * volume ELSE 0.0 END)', 14)} AS mf_neg
  FROM w1b
),
w1 AS (
  SELECT *,
    {roll('avg', 'gain', 14)} AS rsi_gain_14, {roll('avg', 'loss', 14)} AS rsi_loss_14,
    {roll('avg', 'pos_dm', 14)} AS dmi_pos_avg, {roll('avg', 'neg_dm', 14)} AS dmi_neg_avg,
    {roll('avg', 'tr', 14)} AS atr_simple,
    {roll('sum', 'abs_delta', 10)} AS abs_delta_sum_10,
    {roll('avg', 'stoch_k', 3)} AS stoch_d,
    last_value(swing_high IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prev_swing_high,
    last_value(swing_low IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prev_swing_low
  FROM w1c
)"""

# Row-local columns over w1 (names as in the Spark feature frame)
W1_DERIVED = {
    "bb_mid": "sma_20",
    "bb_upper": "sma_20 + 2.0 * std_pop_20",
    "bb_lower": "sma_20 - 2.0 * std_pop_20",
    "bb_width": div("4.0 * std_pop_20", "sma_20"),
    "bb_width_close": div("4.0 * std_pop_20", "close"),
    "bb_pct": div("close - (sma_20 - 2.0 * std_pop_20)", "4.0 * std_pop_20"),
    "volume_ratio": div("volume", "volume_sma"),
    "volume_intensity": div("volume", "volume_sma_10"),
    "true_range": "tr",
    "rsi_simple": rsi_like("rsi_gain_14", "rsi_loss_14"),
    "dmi_plus": f"100.0 * {div('dmi_pos_avg', 'atr_simple')}",
    "dmi_minus": f"100.0 * {div('dmi_neg_avg', 'atr_simple')}",
    "cci": div("tp - tp_avg_20", "0.015 * tp_mad_20"),
    "dpo": "close_lag11 - sma_20",
    "ichimoku_a": "((max_high_9 + min_low_9) / 2.0 + (max_high_26 + min_low_26) / 2.0) / 2.0",
    "ichimoku_b": "(max_high_52 + min_low_52) / 2.0",
    "donchian_width": f"{div('max_high_20 - min_low_20', 'sma_20')} * 100.0",
    "keltner_width": "keltner_upper - keltner_lower",
    "williams_r": f"-100.0 * {div('max_high_14 - close', 'max_high_14 - min_low_14')}",
    "roc": f"{div('close - close_lag12', 'close_lag12')} * 100.0",
    "ease_of_movement": f"{div('((high - prev_high) + (low - prev_low)) * (high - low)', '2.0 * volume')} * 1e8",
    "mfi": rsi_like("mf_pos", "mf_neg"),
    "aroon_osc": "(aroon_hi_rn - aroon_lo_rn) * 100.0 / 25.0",
    "pivot_mean": "tp_avg_20",
    "log_returns": "ln(1.0 + returns)",
    "price_acceleration": "returns - prev_returns",
    "range_pct": div("high - low", "close"),
    "hlc3": "tp",
    "ohlc4": "(open + high + low + close) / 4.0",
    "high_low_ratio": div("high", "low"),
    "close_open_ratio": div("close", "open"),
    "price_position": div("close - low", "high - low"),
    "hl_intensity": "abs(high - low) / (abs(close - open) + 0.001)",
    "trend_intensity": div("abs(close - open)", "high - low"),
    "candle_engulfing": "CASE WHEN prev_close < prev_open AND close > open AND open <= prev_close AND close >= prev_open THEN 1 "
    "WHEN prev_close > prev_open AND close < open AND open >= prev_close AND close <= prev_open THEN -1 ELSE 0 END",
    "candle_doji": "CASE WHEN abs(close - open) <= 0.1 * (high - low) THEN 1 ELSE 0 END",
    "candle_morning_star": "CASE WHEN close_lag2 < open_lag2 AND abs(prev_close - prev_open) <= 0.3 * abs(close_lag2 - open_lag2) "
    "AND greatest(prev_open, prev_close) < close_lag2 AND close > open AND close > (open_lag2 + close_lag2) / 2.0 THEN 1 ELSE 0 END",
    "candle_evening_star": "CASE WHEN close_lag2 > open_lag2 AND abs(prev_close - prev_open) <= 0.3 * abs(close_lag2 - open_lag2) "
    "AND least(prev_open, prev_close) > close_lag2 AND close < open AND close < (open_lag2 + close_lag2) / 2.0 THEN 1 ELSE 0 END",
    "double_top": "CASE WHEN swing_high IS NOT NULL AND abs(swing_high - prev_swing_high) <= 0.005 * prev_swing_high THEN 1 ELSE 0 END",
    "double_bottom": "CASE WHEN swing_low IS NOT NULL AND abs(swing_low - prev_swing_low) <= 0.005 * prev_swing_low THEN 1 ELSE 0 END",
    "fib_pivot": "(prev_high + prev_low + prev_close) / 3.0",
    "fib_r1": "(prev_high + prev_low + prev_close) / 3.0 + 0.382 * (prev_high - prev_low)",
    "fib_r2": "(prev_high + prev_low + prev_close) / 3.0 + 0.618 * (prev_high - prev_low)",
    "fib_r3": "(prev_high + prev_low + prev_close) / 3.0 + (prev_high - prev_low)",
    "fib_s1": "(prev_high + prev_low + prev_close) / 3.0 - 0.382 * (prev_high - prev_low)",
    "fib_s2": "(prev_high + prev_low + prev_close) / 3.0 - 0.618 * (prev_high - prev_low)",
    "fib_s3": "(prev_high + prev_low + prev_close) / 3.0 - (prev_high - prev_low)",
    "support_20": "min_low_20",
    "support_50": "min_low_50",
    "resistance_20": "max_high_20",
    "resistance_50": "max_high_50",
}


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0) AS {name}"


def with_ctes(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


# ---------------------------------------------------------------------------
# Recurrences (recursive CTEs). Coefficients are Python floats printed with repr so
# both engines multiply by the same doubles in the same order.

def _ewm_step(prev: str, x: str, alpha: float) -> str:
    return f"(CASE WHEN {x} IS NULL THEN {prev} ELSE {1.0 - alpha!r} * {prev} + {alpha!r} * {x} END)"


EMA_SPANS = (5, 9, 10, 12, 13, 18, 20, 26, 50, 200)
_KF, _KS = 2.0 / (2 + 1), 2.0 / (30 + 1)

S1_IN = f"""
s1in AS (
  SELECT *,
    pow((CASE WHEN abs_delta_sum_10 = 0 THEN 0.0 ELSE abs(close - close_lag10) / abs_delta_sum_10 END)
        * {_KF - _KS!r} + {_KS!r}, 2.0) AS kama_sc,
    delta_close * volume AS dcv, high - low AS hl,
    CASE WHEN close < prev_close THEN -volume ELSE volume END AS obv_step
  FROM w1
)"""


def _s1_cols():
    init, step = [], []
    for n in EMA_SPANS:
        a = 2.0 / (n + 1)
        init.append(f"close AS ema_{n}")
        step.append(f"{_ewm_step(f'r.ema_{n}', 'x.close', a)} AS ema_{n}")
    for nm, n in (("volume_ema", 20), ("volume_ema_12", 12), ("volume_ema_26", 26)):
        init.append(f"volume AS {nm}")
        step.append(f"{_ewm_step(f'r.{nm}', 'x.volume', 2.0 / (n + 1))} AS {nm}")
    for nm, src in (("rsi_up", "gain"), ("rsi_down", "loss"), ("tr_w", "tr"), ("pos_dm_w", "pos_dm"), ("neg_dm_w", "neg_dm")):
        init.append(f"{src} AS {nm}")
        step.append(f"{_ewm_step(f'r.{nm}', f'x.{src}', 1.0 / 14)} AS {nm}")
    init.append("CAST(NULL AS DOUBLE) AS atr")
    step.append(f"(CASE WHEN x.rn = 13 THEN x.tr_avg_14 WHEN x.rn > 13 THEN {13 / 14!r} * r.atr + x.tr / 14.0 END) AS atr")
    init.append("CAST(NULL AS DOUBLE) AS force_index")
    step.append(f"(CASE WHEN x.rn = 1 THEN x.dcv ELSE {_ewm_step('r.force_index', 'x.dcv', 2.0 / 14)} END) AS force_index")
    init.append("CAST(NULL AS DOUBLE) AS kama")
    step.append("(CASE WHEN x.rn = 9 THEN x.close WHEN x.rn > 9 THEN (1.0 - x.kama_sc) * r.kama + x.kama_sc * x.close END) AS kama")
    init.append("hl AS ema_hl_9")
    step.append(f"{_ewm_step('r.ema_hl_9', 'x.hl', 0.2)} AS ema_hl_9")
    return init, step


_I1, _T1 = _s1_cols()
S1_REC = f"""
s1 AS (
  SELECT symbol, rn, {", ".join(_I1)} FROM s1in WHERE rn = 0
  UNION ALL
  SELECT x.symbol, x.rn, {", ".join(_T1)}
  FROM s1 r JOIN s1in x ON x.symbol = r.symbol AND x.rn = r.rn + 1
)"""

_S1_VALID = {f"ema_{n}": n - 1 for n in EMA_SPANS} | {
    "volume_ema": 0, "volume_ema_12": 0, "volume_ema_26": 0, "rsi_up": 13, "rsi_down": 13,
    "tr_w": 13, "pos_dm_w": 13, "neg_dm_w": 13, "atr": 13, "force_index": 13, "kama": 9, "ema_hl_9": 8,
}

W2 = f"""
s1m AS (
  SELECT x.*, {", ".join(f"CASE WHEN r.rn >= {v} THEN r.{k} END AS {k}" for k, v in _S1_VALID.items())},
    sum(x.dcv) OVER (PARTITION BY x.symbol ORDER BY x.ts ROWS UNBOUNDED PRECEDING) AS vpt_raw,
    sum(x.obv_step) OVER (PARTITION BY x.symbol ORDER BY x.ts ROWS UNBOUNDED PRECEDING) AS obv,
    sum(x.tp * x.volume) OVER (PARTITION BY x.symbol ORDER BY x.ts ROWS UNBOUNDED PRECEDING) AS cum_tpv,
    sum(x.volume) OVER (PARTITION BY x.symbol ORDER BY x.ts ROWS UNBOUNDED PRECEDING) AS cum_v
  FROM s1in x JOIN s1 r ON x.symbol = r.symbol AND x.rn = r.rn
),
w2a AS (
  SELECT *,
    CASE WHEN dcv IS NOT NULL THEN vpt_raw END AS vpt,
    CASE WHEN rsi_down = 0 THEN 100.0 ELSE {rsi_like('rsi_up', 'rsi_down')} END AS rsi,
    ema_12 - ema_26 AS macd,
    100.0 * {div('ema_12 - ema_26', 'ema_26')} AS ppo,
    {div('volume_ema_12 - volume_ema_26', 'volume_ema_26')} * 100.0 AS pvo,
    100.0 * {div('pos_dm_w', 'tr_w')} AS plus_di,
    100.0 * {div('neg_dm_w', 'tr_w')} AS minus_di,
    {roll('avg', 'atr', 20)} AS atr_avg_20,
    {lag('ema_18')} AS prev_trix, {lag('ema_5')} AS prev_ema_5, {lag('ema_20')} AS prev_ema_20,
    {div('cum_tpv', 'cum_v')} AS vwap,
    {div('atr_simple', 'close')} * 100.0 AS atr_pct_simple
  FROM s1m
),
w2 AS (
  SELECT *,
    {roll('min', 'rsi', 14)} AS rsi_min_14, {roll('max', 'rsi', 14)} AS rsi_max_14,
    100.0 * {div('abs(plus_di - minus_di)', 'plus_di + minus_di')} AS dx,
    {lag('obv')} AS prev_obv, {lag('vpt')} AS prev_vpt,
    {roll('min', 'atr_simple', 100)} AS atr_min_100, {roll('max', 'atr_simple', 100)} AS atr_max_100
  FROM w2a
),
s2 AS (
  SELECT symbol, rn, CAST(NULL AS DOUBLE) AS macd_signal, CAST(NULL AS DOUBLE) AS adx, CAST(NULL AS DOUBLE) AS ema_hl_9_9
  FROM w2 WHERE rn = 0
  UNION ALL
  SELECT x.symbol, x.rn,
    (CASE WHEN x.rn = 25 THEN x.macd WHEN x.rn > 25 THEN {_ewm_step('r.macd_signal', 'x.macd', 0.2)} END),
    (CASE WHEN x.rn = 13 THEN x.dx WHEN x.rn > 13 THEN {_ewm_step('r.adx', 'x.dx', 1.0 / 14)} END),
    (CASE WHEN x.rn = 8 THEN x.ema_hl_9 WHEN x.rn > 8 THEN {_ewm_step('r.ema_hl_9_9', 'x.ema_hl_9', 0.2)} END)
  FROM s2 r JOIN w2 x ON x.symbol = r.symbol AND x.rn = r.rn + 1
),
f0 AS (
  SELECT x.*,
    CASE WHEN r.rn >= 33 THEN r.macd_signal END AS macd_signal,
    CASE WHEN r.rn >= 26 THEN r.adx END AS adx,
    CASE WHEN r.rn >= 16 THEN r.ema_hl_9_9 END AS ema_hl_9_9
  FROM w2 x JOIN s2 r ON x.symbol = r.symbol AND x.rn = r.rn
),
f AS (
  SELECT *, {roll('sum', div('ema_hl_9', 'ema_hl_9_9'), 25)} AS mass_index FROM f0
)"""

F_DERIVED = W1_DERIVED | {
    "trix": "ema_18",
    "rsi_wilder": "rsi",
    "macd_hist": "macd - macd_signal",
    "stoch_rsi": div("rsi - rsi_min_14", "rsi_max_14 - rsi_min_14"),
    "vwap_cum": "vwap",
    "volatility_norm": f"(CASE WHEN {div('atr_max_100', 'close')} = {div('atr_min_100', 'close')} THEN 0.0 ELSE round({div(f"{div('atr_simple', 'close')} * 100.0 - {div('atr_min_100', 'close')} * 100.0", f"{div('atr_max_100', 'close')} * 100.0 - {div('atr_min_100', 'close')} * 100.0")} * 100.0, 2) END)",
}
FULL_CTES = [BARS_1H, W1A, S1_IN, S1_REC, W2]

FD = "fd AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in F_DERIVED.items() if k not in ("trix",)) + ", ema_18 AS trix FROM f)"
FD_CTES = FULL_CTES + [FD]
