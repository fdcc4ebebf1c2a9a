"""Registered queries: change-point trend, AdaBoost, kernel SVC, isolation forest, total order, signal roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals as SG
from ..operators import boosting as BO
from ..operators import isolation as IS
from ..operators import kernel as KE
from ..operators import ml as ML
from ..operators import order as OD
from ..operators import trend as TR
from ..operators.knn import standardised
from . import oracle_sql as Q
from .catalog import _STRAT_SQL, _strategy_frame, bars_1h, r6, register

# 25 knots over 80 % of the time and 4 daily harmonics: 35 coefficients, by Gauss-Jordan steps over lists.
_D = 35
_CURVE = (
    "list_concat([1.0::DOUBLE, {t}], list_transform(range(1, 26), lambda k: greatest({t} - 0.8 * k / 25.0, 0.0)), "
    "list_transform(range(0, 8), lambda k: CASE WHEN k % 2 = 0 THEN sin(2.0 * pi() * (k // 2 + 1) * {p}) ELSE cos(2.0 * pi() * (k // 2 + 1) * {p}) END))"
)


def _place(ts: str) -> tuple[str, str]:
    t = f"(CASE WHEN hi = lo THEN 0.0 ELSE epoch_us({ts} - lo) / epoch_us(hi - lo)::DOUBLE END)"
    return t, f"((hour({ts}) * 3600 + minute({ts}) * 60 + second({ts})) / 86400.0::DOUBLE)"


_T, _P = _place("ts")
_TN, _PN = _place("next_ts")
_TREND_SQL = (
    f"WITH RECURSIVE {Q.BARS_1H}, en AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY symbol), "
    f"xs AS (SELECT symbol, ts, close, {_CURVE.format(t=_T, p=_P)} AS x FROM bars JOIN en USING (symbol)), "
    f"xy AS (SELECT symbol, ts, x, list_append(x, close) AS z FROM xs), "
    f"pr AS (SELECT symbol, i, j, sum(x[i] * z[j]) AS v FROM xy, range(1, {_D + 1}) AS a(i), range(1, {_D + 2}) AS c(j) GROUP BY symbol, i, j), "
    "ro AS (SELECT symbol, i, list(v + CASE WHEN i <> j OR i = 1 THEN 0.0 WHEN i = 2 THEN 0.000001 ELSE 0.01 END ORDER BY j) AS r FROM pr GROUP BY symbol, i), "
    "gj AS (SELECT symbol, 1::BIGINT AS k, list(r ORDER BY i) AS m FROM ro GROUP BY symbol "
    "UNION ALL SELECT symbol, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) "
    f"ELSE list_transform(r, lambda v, j: v - m[k][j] * (r[k] / m[k][k])) END) FROM gj WHERE k <= {_D}), "
    f"co AS (SELECT symbol, list_transform(m, lambda r: r[{_D + 1}]) AS coef FROM gj WHERE k = {_D + 1})"
)


@register(
    "changepoint_components",
    f"{_TREND_SQL} SELECT symbol, ts, {Q.r6('list_dot_product(coef[1:27], x[1:27])', 'trend', 4)}, {Q.r6(f'list_dot_product(coef[28:{_D}], x[28:{_D}])', 'seasonal', 4)} FROM xs JOIN co USING (symbol)",
)
def q_changepoint_components(spark, sf_dir):
    """Trend with change points and daily seasonality of every bar."""
    bars = bars_1h(spark, sf_dir).select("symbol", "ts", "close").checkpoint(eager=True)
    return TR.components(bars, TR.fit_trend(bars)).select("symbol", "ts", r6("trend", digits=4), r6("seasonal", digits=4))


@register(
    "changepoint_forecast",
    f"{_TREND_SQL}, la AS (SELECT symbol, max(ts) + INTERVAL 1 HOUR AS next_ts, arg_max(close, ts) AS close FROM bars GROUP BY symbol), "
    f"fc AS (SELECT symbol, next_ts, close, list_dot_product(coef, {_CURVE.format(t=_TN, p=_PN)}) AS y FROM la JOIN en USING (symbol) JOIN co USING (symbol)) "
    f"SELECT symbol, next_ts, {Q.r6('close', 'close')}, {Q.r6('y', 'forecast', 4)}, CASE WHEN y > close THEN 'up' ELSE 'down' END AS direction FROM fc",
)
def q_changepoint_forecast(spark, sf_dir):
    """The fitted curve one bar ahead of each series against its last close."""
    bars = bars_1h(spark, sf_dir).select("symbol", "ts", "close").checkpoint(eager=True)
    return TR.trend_forecast(bars).select("symbol", "next_ts", r6("close"), r6("forecast", digits=4), "direction")


@register(
    "change_points",
    f"{_TREND_SQL} SELECT symbol, k::INTEGER AS knot, strftime(lo + to_microseconds(round(k * (0.8 / 25) * epoch_us(hi - lo))::BIGINT), '%Y-%m-%d %H:%M:%S') AS at, {Q.r6('coef[2 + k]', 'change', 4)} "
    "FROM co JOIN en USING (symbol), range(1, 26) AS r(k)",
)
def q_change_points(spark, sf_dir):
    """Change of slope at each possible change point of each series."""
    bars = bars_1h(spark, sf_dir).select("symbol", "ts", "close").checkpoint(eager=True)
    return TR.change_points(TR.fit_trend(bars)).select("symbol", F.col("knot").cast("int").alias("knot"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), r6("change", digits=4))


ROUNDS = 20


@register("clf_adaboost", None)
def q_clf_adaboost(spark, sf_dir):
    """Next bar's direction by boosted stumps over the twelve prediction features, 20 rounds."""
    p = ML.panel(bars_1h(spark, sf_dir))
    stumps = BO.fit_boosted(p.filter(~F.col("is_test")), ML.FEATURES_12, rounds=ROUNDS)
    return BO.score_boosted(p.filter("is_test"), stumps).select("symbol", "ts", F.lit("AdaBoost").alias("model"), r6("prob_up"), "prediction", "label")


@register("clf_rbf_svc", None)
def q_clf_rbf_svc(spark, sf_dir):
    """Next bar's direction by a kernel SVC over the twelve prediction features."""
    out = KE.rbf_svc(ML.panel(bars_1h(spark, sf_dir)), ML.FEATURES_12)
    return out.select("symbol", "ts", F.lit("SVC").alias("model"), r6("prob_up"), "prediction", "label")


@register("clf_isolation_forest", None)
def q_clf_isolation_forest(spark, sf_dir):
    """Anomaly score of every bar by a forest of the train rows; test rows within the train rows' 90 % count as up."""
    p = standardised(ML.panel(bars_1h(spark, sf_dir)), ML.FEATURES_12).withColumn("key", F.xxhash64("symbol", "ts"))
    forest = IS.fit_forest(p.filter(~F.col("is_test")), "key")
    scored = IS.score_forest(p, forest).checkpoint(eager=True)
    out = IS.outliers(scored, scored.filter(~F.col("is_test")))
    return out.select("symbol", "ts", "is_test", r6("anomaly"), "inlier", "label")


@register("sort_time", f"WITH {Q.BARS_1H} SELECT row_number() OVER (ORDER BY ts, symbol) - 1 AS row, ts, symbol, {Q.r6('close', 'close')} FROM bars")
def q_sort_time(spark, sf_dir):
    """All bars in one order of time, each with its place."""
    return OD.total_order(bars_1h(spark, sf_dir).select("ts", "symbol", "close"), ["ts", "symbol"]).select("row", "ts", "symbol", r6("close"))


_NAMES = [n for n, _, _ in SG.STRATEGY_RULES]


@register(
    "signal_rollup",
    f"{_STRAT_SQL}, u AS (UNPIVOT (SELECT symbol, ts, {', '.join(f'sig_{n}' for n in _NAMES)} FROM s) ON {', '.join(f'sig_{n}' for n in _NAMES)} INTO NAME strategy VALUE signal) "
    "SELECT symbol, strategy, grouping(symbol, strategy) AS level, count(*) AS n_bars, count_if(signal = 1) AS n_buy, count_if(signal = -1) AS n_sell "
    "FROM (SELECT symbol, substr(strategy, 5) AS strategy, signal FROM u) GROUP BY ROLLUP (symbol, strategy)",
)
def q_signal_rollup(spark, sf_dir):
    """Buy and sell bars of each rule per symbol, of each symbol, and in all."""
    return OD.signal_rollup(_strategy_frame(spark, sf_dir), _NAMES)
