"""Registered queries: walk-forward folds, grid search over them, GARCH(1,1), nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.indicators import features
from ..operators import garch as G
from ..operators import knn as KN
from ..operators import ml as ML
from ..operators import walkforward as WF
from ..operators.series import drop_layout, numbered
from . import oracle_sql as Q
from .catalog import bars_1h, r6, register

SPLITS = 3


@register(
    "walk_forward_folds",
    f"WITH {Q.BARS_1H}, u AS (SELECT symbol, ts, epoch_us(ts) AS now, epoch_us(lead(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS known FROM bars), "
    "s AS (SELECT min(now) AS lo, max(now) - min(now) + 1 AS span FROM u), "
    f"c AS (SELECT k AS fold, lo + (k * span + {SPLITS}) // {SPLITS + 1} AS begins, CASE WHEN k = {SPLITS} THEN lo + span ELSE lo + ((k + 1) * span + {SPLITS}) // {SPLITS + 1} END AS ends "
    f"FROM s, (SELECT unnest(range(1, {SPLITS + 1}))::BIGINT AS k)) "
    "SELECT symbol, ts, fold::INTEGER AS fold, CASE WHEN now >= begins THEN 'test' ELSE 'train' END AS role FROM u JOIN c ON (now >= begins AND now < ends) OR known < begins",
)
def q_walk_forward_folds(spark, sf_dir):
    """Every bar in its rolling-origin folds; a train row's label is known before the test span begins."""
    f = WF.label_until(numbered(bars_1h(spark, sf_dir).select("symbol", "ts")))
    return WF.folds(drop_layout(f), SPLITS, until="until").select("symbol", "ts", "fold", "role")


@register("tune_grid", None)
def q_tune_grid(spark, sf_dir):
    """Random forests over the corners of the search ranges, each fitted and scored in every fold."""
    cols = ML.FEATURES_12
    f = WF.label_until(features(bars_1h(spark, sf_dir), [*cols, "returns"]))
    f = ML.forward_labels(f).select("symbol", "ts", "until", *cols, F.col("label_up_1").cast("double").alias("label"))
    panel = ML.sized(f.na.drop(subset=[*cols, "label"]))
    out = WF.tune_grid(WF.folds(panel, SPLITS, until="until"), cols)
    return out.select("trial", *WF.FOREST_GRID, "fold", "n_train", "n_test", r6("accuracy"), r6("log_loss"), "rank")


_POINTS = G.grid_points()
_GARCH_SQL = (
    f"WITH RECURSIVE {Q.BARS_1H}, r AS (SELECT symbol, rn, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1.0 AS x FROM b), "
    "k AS (SELECT symbol, rn, x * x AS r2 FROM r WHERE x IS NOT NULL), m AS (SELECT symbol, avg(r2) AS s2, count(*) AS n, max(rn) AS last, median(r2) AS med FROM k GROUP BY symbol), "
    "g(point, alpha, beta) AS (VALUES " + ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in enumerate(_POINTS)) + "), "
    "v AS (SELECT k.symbol, g.point, k.rn, k.r2, m.s2 AS var FROM k JOIN m ON m.symbol = k.symbol, g WHERE k.rn = 1 "
    "UNION ALL SELECT k.symbol, g.point, k.rn, k.r2, (1.0 - g.alpha - g.beta) * m.s2 + g.alpha * v.r2 + g.beta * v.var "
    "FROM v JOIN k ON k.symbol = v.symbol AND k.rn = v.rn + 1 JOIN g ON g.point = v.point JOIN m ON m.symbol = v.symbol), "
    "l AS (SELECT symbol, point, -0.5 * sum(ln(var) + r2 / var ORDER BY rn) AS ll FROM v GROUP BY symbol, point), "
    "t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(ll, 6) DESC, point) = 1) "
    f"SELECT t.symbol, g.alpha, g.beta, {Q.r6('t.ll', 'log_likelihood')}, {Q.r6('(1.0 - g.alpha - g.beta) * m.s2 + g.alpha * v.r2 + g.beta * v.var', 'forecast_variance')}, "
    "CASE WHEN (1.0 - g.alpha - g.beta) * m.s2 + g.alpha * v.r2 + g.beta * v.var > m.med THEN 'up' ELSE 'down' END AS vote "
    "FROM t JOIN g ON g.point = t.point JOIN m ON m.symbol = t.symbol JOIN v ON v.symbol = t.symbol AND v.point = t.point AND v.rn = m.last"
)


@register("garch_vote", _GARCH_SQL)
def q_garch_vote(spark, sf_dir):
    """GARCH(1,1) of each symbol by likelihood over a grid, its next variance, and the vote against the median."""
    f = features(bars_1h(spark, sf_dir), ["returns"])
    return G.garch_vote(f).select("symbol", "alpha", "beta", r6("log_likelihood"), r6("forecast_variance"), "vote")


_KNN_COLS = ["rsi_simple", "bb_pct", "williams_r", "cci", "stoch_k"]
_KNN_SQL = (
    f"{Q.with_ctes(*Q.FD_CTES)}, n AS (SELECT symbol, ts, {', '.join(_KNN_COLS)}, lead(close) OVER (PARTITION BY symbol ORDER BY ts) > close AS up, "
    "row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 >= floor(0.8 * count(*) OVER (PARTITION BY symbol)) AS is_test FROM fd), "
    f"p AS (SELECT * FROM n WHERE up IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _KNN_COLS)}), "
    f"s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _KNN_COLS)} FROM p WHERE NOT is_test), "
    f"z AS (SELECT symbol, ts, up, is_test, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in _KNN_COLS)} FROM p, s), "
    f"d AS (SELECT q.symbol, q.ts, t.up, row_number() OVER (PARTITION BY q.symbol, q.ts ORDER BY {' + '.join(f'(q.{c} - t.{c}) * (q.{c} - t.{c})' for c in _KNN_COLS)}, t.symbol, t.ts) AS k "
    "FROM z q JOIN z t ON q.is_test AND NOT t.is_test) "
    "SELECT symbol, ts, round(avg(up::INTEGER), 6) AS prob_up, (avg(up::INTEGER) > 0.5)::INTEGER::DOUBLE AS prediction FROM d WHERE k <= 5 GROUP BY symbol, ts"
)


@register("clf_knn", _KNN_SQL)
def q_clf_knn(spark, sf_dir):
    """Next bar's direction by the five nearest train rows, found through a k-d partition."""
    p = KN.standardised(ML.panel(bars_1h(spark, sf_dir), _KNN_COLS), _KNN_COLS)
    rows = p.withColumn("id", F.xxhash64("symbol", "ts"))
    votes = KN.classify(rows.filter(~F.col("is_test")).select("id", "x", "label"), rows.filter("is_test").select("id", "x"))
    return rows.select("symbol", "ts", "id").join(votes, F.col("id") == F.col("test")).select("symbol", "ts", r6("prob_up"), "prediction")
