"""Registered queries: feature sets, filled labels, random split, closed-form classifiers, regressors' forecasts."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from ..functions import feature_sets as FS
from ..functions import reports as RP
from ..functions import signals as SG
from ..functions.indicators import features
from ..operators import consensus as CS
from ..operators import labels as LB
from ..operators import linear as LI
from ..operators import ml as ML
from ..operators.series import drop_layout
from . import oracle_sql as Q
from .catalog import _LBL_SQL, _STRAT_SQL, DIGITS, _features_for, _strategy_frame, bars_1h, r6, register

_FD = Q.with_ctes(*Q.FD_CTES)


def _list_builder(cols):
    def build(spark, sf_dir):
        return _features_for(spark, sf_dir, cols).select("symbol", "ts", *[r6(c, digits=DIGITS.get(c, 6)) for c in cols])

    return build


for _key, _cols in (("feature_list_33", FS.FEATURES_33), ("feature_list_8", FS.FEATURES_8), ("feature_list_7", FS.FEATURES_7)):
    register(_key, f"{_FD} SELECT symbol, ts, {', '.join(Q.r6(c, c, DIGITS.get(c, 6)) for c in _cols)} FROM fd")(_list_builder(_cols))

_SET_COLS = sorted({c for cols in FS.FEATURE_SETS.values() for c in cols})
_SET_ENTRIES = ", ".join(f"{{'strategy': '{s}', 'feature': '{c}', 'value': round(CAST({c} AS DOUBLE), 6) + 0.0}}" for s, cols in FS.FEATURE_SETS.items() for c in cols)


@register("feature_sets", f"{_FD}, u AS (SELECT symbol, ts, unnest([{_SET_ENTRIES}]) AS e FROM fd) SELECT symbol, ts, e.strategy AS strategy, e.feature AS feature, e.value AS value FROM u")
def q_feature_sets(spark, sf_dir):
    """What each paired strategy's model learns from, at every bar."""
    return FS.strategy_features(_features_for(spark, sf_dir, _SET_COLS))


@register("label_next_return_filled", f"{_LBL_SQL} SELECT symbol, ts, {Q.r6('last_value(nr IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts)', 'next_return')} FROM x")
def q_label_next_return_filled(spark, sf_dir):
    """The next bar's return; the last bar, whose next one is not known, keeps the label before it."""
    f = LB.forward_labels(features(bars_1h(spark, sf_dir), ["returns"]))
    return f.select("symbol", "ts", r6(LB.filled_next_return(), "next_return"))


_NAMES = [n for n, _, _ in SG.STRATEGY_RULES]


def _logits_sql(n: int, names: list[str]) -> str:
    sums = ", ".join("(" + " + ".join(f"sig_{x}" for x in _NAMES[k::n]) + ")::DOUBLE" for k in range(n))
    labels = "[" + ", ".join(f"'{x}'" for x in names) + "]"
    return (
        f"{_STRAT_SQL}, l AS (SELECT symbol, ts, [{sums}] AS x FROM s), e AS (SELECT symbol, ts, x, list_transform(x, lambda v: exp(v - list_max(x))) AS q FROM l) "
        f"SELECT symbol, ts, {labels}[list_position(x, list_max(x))] AS label, {Q.r6('1.0 / list_sum(q)', 'confidence')}, "
        "CASE WHEN round(1.0 / list_sum(q), 9) > 0.8 THEN 'high' WHEN round(1.0 / list_sum(q), 9) > 0.6 THEN 'medium' ELSE 'low' END AS strength FROM e"
    )


def _softmax_builder(n: int):
    def build(spark, sf_dir):
        votes = [sum((F.col(f"sig_{x}") for x in _NAMES[k::n]), F.lit(0)).cast("double") for k in range(n)]
        logits = _strategy_frame(spark, sf_dir).select("symbol", "ts", F.array(*votes).alias("logits"))
        out = CS.softmax_argmax(logits, CS.directions(n))
        sure = F.round("label_confidence", 9)
        return out.select("symbol", "ts", "label", r6("label_confidence", "confidence"), F.when(sure > 0.8, "high").when(sure > 0.6, "medium").otherwise("low").alias("strength"))

    build.__doc__ = f"The rules' votes in {n} groups as logits of {n} labels."
    return build


register("softmax_argmax_5", _logits_sql(5, ["strong_uptrend", "weak_uptrend", "sideways", "weak_downtrend", "strong_downtrend"]))(_softmax_builder(5))
register("softmax_argmax_7", _logits_sql(7, [f"class_{k}" for k in range(7)]))(_softmax_builder(7))


@register(
    "split_random",
    f"WITH {Q.BARS_1H} SELECT symbol, ts, ('0x' || substr(md5('42|' || symbol || '|' || epoch_us(ts)::VARCHAR), 1, 8))::BIGINT < floor(0.2 * 4294967296) AS is_test FROM bars",
)
def q_split_random(spark, sf_dir):
    """A shuffled split of the bars by a hash of each row's key."""
    b = bars_1h(spark, sf_dir).select("symbol", "ts")
    return LB.split_random(b, [F.col("symbol"), F.unix_micros(F.col("ts").cast("timestamp"))])


# The panel of the twelve prediction features, standardised by the train rows, as a list x of doubles.
_F12 = ML.FEATURES_12
_D = len(_F12)
_PANEL_SQL = (
    f"{_FD}, n AS (SELECT symbol, ts, {', '.join(_F12)}, lead(close) OVER (PARTITION BY symbol ORDER BY ts) > close AS up, "
    "row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 >= floor(0.8 * count(*) OVER (PARTITION BY symbol)) AS is_test FROM fd), "
    f"p AS (SELECT * FROM n WHERE up IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _F12)}), "
    f"mo AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _F12)} FROM p WHERE NOT is_test), "
    f"z AS (SELECT symbol, ts, up::INTEGER AS y, is_test, [{', '.join(f'({c} - m_{c}) / s_{c}' for c in _F12)}] AS x FROM p, mo), "
    "tr AS (SELECT y, x FROM z WHERE NOT is_test), ix AS (SELECT unnest(range(1, 13)) AS i)"
)
_PROB = "1.0 / (1.0 + exp(greatest(least({s0} - {s1}, 700.0), -700.0)))"
_SCORED = f"SELECT symbol, ts, {Q.r6('p', 'prob_up')}, (p > 0.5)::INTEGER::DOUBLE AS prediction, y::DOUBLE AS label FROM o"


@register(
    "clf_naive_bayes",
    f"{_PANEL_SQL}, ep AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT var_pop(x[i]) AS v FROM tr, ix GROUP BY i)), "
    "g AS (SELECT y, i, avg(x[i]) AS mu, var_pop(x[i]) + any_value(eps) AS v, count(*) AS n FROM tr, ix, ep GROUP BY y, i), "
    "h AS (SELECT y, list(mu ORDER BY i) AS mu, list(v ORDER BY i) AS v, any_value(n) AS n FROM g GROUP BY y), "
    f"c AS (SELECT z.symbol, z.ts, z.y, h.y AS k, ln(h.n) - 0.5 * list_sum(list_transform(range(1, {_D + 1}), lambda i: ln(2.0 * pi() * h.v[i]) + pow(z.x[i] - h.mu[i], 2) / h.v[i])) AS s FROM z, h WHERE z.is_test), "
    f"o AS (SELECT symbol, ts, y, {_PROB.format(s0='max(s) FILTER (k = 0)', s1='max(s) FILTER (k = 1)')} AS p FROM c GROUP BY symbol, ts, y) {_SCORED}",
)
def q_clf_naive_bayes(spark, sf_dir):
    """Next bar's direction by Gaussian naive Bayes over the twelve prediction features."""
    spec = [m for m in ML.default_models() if m.name == "GaussianNB"]
    preds, _ = ML.bakeoff(ML.panel(bars_1h(spark, sf_dir)), _F12, spec)
    return preds.select("symbol", "ts", r6("prob_up"), "prediction", "label")


def _gauss_jordan(source: str, group: str, width: int) -> str:
    """Rows r (by i) of one matrix for each group, reduced to the identity on the left; ld is the log-determinant."""
    return (
        f"gj AS (SELECT {group}, 1::BIGINT AS k, list(r ORDER BY i) AS m, 0.0::DOUBLE AS ld FROM {source} GROUP BY {group} "
        f"UNION ALL SELECT {group}, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) "
        f"ELSE list_transform(r, lambda v, j: v - m[k][j] * (r[k] / m[k][k])) END), ld + ln(m[k][k]) FROM gj WHERE k <= {width})"
    )


def _discriminant_sql(quadratic: bool) -> str:
    cov = "SELECT y, a.i, b.i AS j, covar_samp(x[a.i], x[b.i]) AS v FROM tr, ix a, ix b GROUP BY y, a.i, b.i"
    if not quadratic:
        cov = f"SELECT w.y, i, j, sum((n.n - 1) * v) OVER (PARTITION BY i, j) / (sum(n.n) OVER (PARTITION BY i, j) - 2.0) AS v FROM ({cov}) w JOIN (SELECT y, count(*) AS n FROM tr GROUP BY y) n ON n.y = w.y"
    return (
        f"{_PANEL_SQL}, cv AS ({cov}), "
        "ro AS (SELECT y AS c, i, list_concat(list(0.9 * v + CASE WHEN i = j THEN 0.1 ELSE 0.0 END ORDER BY j), list_transform(range(1, 13), lambda j: CASE WHEN j = i THEN 1.0 ELSE 0.0 END)) AS r FROM cv GROUP BY y, i), "
        f"{_gauss_jordan('ro', 'c', _D)}, iv AS (SELECT c, list_transform(m, lambda r: r[13:24]) AS inv, ld FROM gj WHERE k = {_D + 1}), "
        "mu AS (SELECT y AS c, list(v ORDER BY i) AS mu, any_value(n) AS n FROM (SELECT y, i, avg(x[i]) AS v, count(*) AS n FROM tr, ix GROUP BY y, i) GROUP BY y), "
        "d AS (SELECT symbol, ts, y, c, inv, ld, n, list_transform(range(1, 13), lambda i: x[i] - mu[i]) AS e FROM z JOIN (SELECT * FROM iv JOIN mu USING (c)) q ON is_test), "
        "k AS (SELECT symbol, ts, y, c, ln(n) - 0.5 * ld - 0.5 * list_sum(list_transform(range(1, 13), lambda i: e[i] * list_dot_product(inv[i], e))) AS s FROM d), "
        f"o AS (SELECT symbol, ts, y, {_PROB.format(s0='max(s) FILTER (c = 0)', s1='max(s) FILTER (c = 1)')} AS p FROM k GROUP BY symbol, ts, y) {_SCORED}"
    )


def _discriminant_builder(quadratic: bool):
    def build(spark, sf_dir):
        out = ML.discriminant(ML.panel(bars_1h(spark, sf_dir)), quadratic=quadratic)
        return out.select("symbol", "ts", r6("prob_up"), "prediction", "label")

    build.__doc__ = f"Next bar's direction by the {'quadratic' if quadratic else 'linear'} Gaussian discriminant."
    return build


register("clf_lda", _discriminant_sql(False))(_discriminant_builder(False))
register("clf_qda", _discriminant_sql(True))(_discriminant_builder(True))


def _ridge_sql(d: int) -> str:
    """Weights w and mean target ym of a ridge (alpha = 1) over the train rows tr(x, t)."""
    return (
        f"me AS (SELECT avg(t) AS ym FROM tr), jx AS (SELECT unnest(range(1, {d + 1})) AS i), "
        f"ro AS (SELECT 0 AS c, i, list(v + CASE WHEN i = j THEN 1.0 ELSE 0.0 END ORDER BY j) AS r FROM (SELECT a.i, b.j, sum(x[a.i] * CASE WHEN b.j > {d} THEN t - ym ELSE x[b.j] END) AS v "
        f"FROM tr, me, jx a, (SELECT unnest(range(1, {d + 2})) AS j) b GROUP BY a.i, b.j) GROUP BY i), "
        f"{_gauss_jordan('ro', 'c', d)}, we AS (SELECT list_transform(m, lambda r: r[{d + 1}]) AS w, ym FROM gj, me WHERE k = {d + 1})"
    )


@register(
    "clf_ridge",
    f"{_PANEL_SQL.replace('tr AS (SELECT y, x ', 'tr AS (SELECT 2.0 * y - 1.0 AS t, x ')}, {_ridge_sql(_D)}, "
    "o AS (SELECT symbol, ts, y, ym + list_dot_product(w, x) AS p FROM z, we WHERE is_test) "
    f"SELECT symbol, ts, {Q.r6('p', 'margin')}, (p > 0)::INTEGER::DOUBLE AS prediction, y::DOUBLE AS label FROM o",
)
def q_clf_ridge(spark, sf_dir):
    """Next bar's direction by a ridge fit over the twelve prediction features."""
    out = LI.classify_ridge(ML.panel(bars_1h(spark, sf_dir)), _F12)
    return out.select("symbol", "ts", r6("margin"), "prediction", "label")


# Forecasts from a predicted next return.
_F7 = FS.FEATURES_7


def _return_rows(spark, sf_dir):
    """Bars with the seven regression features, the filled next return and the split; rows without a feature left out."""
    f = LB.split_chrono(LB.forward_labels(features(bars_1h(spark, sf_dir), [*_F7, "returns"])))
    rows = drop_layout(f.withColumn("target", LB.filled_next_return())).select("symbol", "ts", "close", *_F7, "target", "is_test")
    return rows.na.drop(subset=[*_F7, "target"]).checkpoint(eager=True)


def _last_rows(scored, cols):
    """The last bar of each symbol that has all features."""
    last = scored.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "volatility", *cols), "ts").alias("_l"))
    return last.select("symbol", "_l.*")


def _forecast(latest, keys):
    """Ten compounded steps from each row, with 7 significant digits."""
    out = RP.forecast_compound(latest, "r", "volatility", keys=keys)
    return out.select(*keys, "step", "date", *[F.format_string("%.6e", F.col(c)).alias(c) for c in ("forecast", "upper_bound", "lower_bound")])


_STEPS_SQL = ", ".join(f"printf('%.6e', close * pow(1.0 + r{b}, step)) AS {n}" for n, b in (("forecast", ""), ("upper_bound", " + volatility"), ("lower_bound", " - volatility")))


@register(
    "forecast_ridge",
    f"{_FD}, n AS (SELECT symbol, ts, close, {', '.join(_F7)}, last_value(nr IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS t, "
    "row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 >= floor(0.8 * count(*) OVER (PARTITION BY symbol)) AS is_test "
    "FROM (SELECT *, lead(returns) OVER (PARTITION BY symbol ORDER BY ts) AS nr FROM fd)), "
    f"p AS (SELECT * FROM n WHERE t IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _F7)}), "
    f"mo AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _F7)} FROM p WHERE NOT is_test), "
    f"z AS (SELECT symbol, ts, close, volatility, t, is_test, [{', '.join(f'({c} - m_{c}) / s_{c}' for c in _F7)}] AS x FROM p, mo), "
    f"tr AS (SELECT t, x FROM z WHERE NOT is_test), {_ridge_sql(len(_F7))}, "
    "la AS (SELECT symbol, ts, close, volatility, ym + list_dot_product(w, x) AS r FROM z, we QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) "
    f"SELECT symbol, step::INTEGER AS step, strftime(ts + step * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS date, {_STEPS_SQL} FROM la, range(1, 11) AS s(step)",
)
def q_forecast_ridge(spark, sf_dir):
    """Ten steps ahead by the next return that a ridge fit of the seven features predicts."""
    rows = _return_rows(spark, sf_dir)
    model = LI.fit_ridge(rows.filter(~F.col("is_test")), _F7, "target")
    return _forecast(_last_rows(rows.withColumn("r", model.score()), ["r"]), ["symbol"])


@register("forecast_regressors", None)
def q_forecast_regressors(spark, sf_dir):
    """Ten steps ahead by the next return that a random forest, boosted trees and their mean predict."""
    rows = _return_rows(spark, sf_dir)
    trees = {
        "random_forest": RandomForestRegressor(labelCol="target", numTrees=50, maxDepth=3, seed=42, predictionCol="r_random_forest"),
        "boosted_trees": GBTRegressor(labelCol="target", maxIter=50, maxDepth=3, seed=42, predictionCol="r_boosted_trees"),
    }
    stages = [*ML._prep(_F7), *trees.values()]
    scored = Pipeline(stages=stages).fit(rows.filter(~F.col("is_test"))).transform(rows).drop("_raw", "features")
    scored = scored.withColumn("r_ensemble", (F.col("r_random_forest") + F.col("r_boosted_trees")) / 2.0)
    last = _last_rows(scored, ["r_random_forest", "r_boosted_trees", "r_ensemble"])
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"r_{m}").alias("r")) for m in (*trees, "ensemble")])
    return _forecast(last.select("symbol", "ts", "close", "volatility", F.inline(models)), ["symbol", "model"])
