"""Walk-forward folds never train on the future, the grid is whole, GARCH equals a plain loop."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from candleframe.functions.indicators import features
from candleframe.operators import garch as G
from candleframe.operators import walkforward as WF


def panel(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 2))
    rows = [("s" if k % 3 else "t", k, float(x[k, 0]), float(x[k, 1]), float(x[k, 0] > 0), k + 2 if k + 2 < n else None) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, k long, a double, b double, label double, u long")
    return df.withColumns({"ts": F.timestamp_seconds(F.col("k") * 60), "until": F.timestamp_seconds(F.col("u") * 60)})


def test_no_train_row_knows_its_test_span(spark):
    f = WF.folds(panel(spark), 4, until="until")
    spans = f.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("until"))).alias("known"), F.min(F.when(F.col("role") == "test", F.col("ts"))).alias("begins"), F.count_if(F.col("role") == "test").alias("n")).collect()
    assert sorted(r.fold for r in spans) == [1, 2, 3, 4]
    assert all(r.known < r.begins for r in spans)
    assert sum(r.n for r in spans) == 320  # the first span is never tested, every other row once
    assert f.filter("role = 'test'").groupBy("k").count().filter("count > 1").isEmpty()
    plain = {(k, fold) for fold in range(1, 5) for k in range(400) if k + 2 < 400 and (k + 2) * 60 * 10**6 < -(-fold * (399 * 60 * 10**6 + 1) // 5)}
    assert {(r.k, r.fold) for r in f.filter("role = 'train'").collect()} == plain


def test_folds_of_nothing(spark):
    empty = panel(spark).limit(0)
    assert WF.folds(empty, 3).columns == [*empty.columns, "fold", "role"] and WF.folds(empty, 3).isEmpty()
    with pytest.raises(ValueError):
        WF.folds(empty, 0)


def test_grid_finds_the_planted_signal(spark):
    grid = {"regParam": [0.0, 100.0], "maxIter": [5, 20]}
    out = WF.tune_grid(WF.folds(panel(spark), 3, until="until"), ["a", "b"], grid, LogisticRegression()).collect()
    assert len(out) == 4 * (3 + 1)
    assert {(r.regParam, r.maxIter) for r in out} == {(0.0, 5), (0.0, 20), (100.0, 5), (100.0, 20)}
    best = [r for r in out if r["rank"] == 1]
    assert {r.regParam for r in best} == {0.0} and min(r.accuracy for r in best) > 0.9
    for trial in range(4):
        own = [r for r in out if r.trial == trial]
        mean = next(r for r in own if r.fold == 0)
        assert mean.log_loss == pytest.approx(np.mean([r.log_loss for r in own if r.fold]))
        assert mean.n_test == 300


def test_grid_without_a_fit(spark):
    one_class = panel(spark).withColumn("label", F.lit(1.0))
    assert WF.tune_grid(WF.folds(one_class, 2), ["a"], {"maxIter": [5]}, LogisticRegression()).isEmpty()


def plain_garch(r, points):
    r2 = np.array(r) ** 2
    s2, best = r2.mean(), None
    for a, b in points:
        var, ll = s2, 0.0
        for x in r2:
            ll -= 0.5 * (np.log(var) + x / var)
            var = (1 - a - b) * s2 + a * x + b * var
        if best is None or ll > best[2] + 1e-9:
            best = (a, b, ll, var)
    return best


def test_garch_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for name, n in (("long", 700), ("short", 9)):
        var, price, r = 1e-4, 100.0, []
        for k in range(n):
            if k:
                x = float(rng.standard_normal() * np.sqrt(var))
                var = 2e-5 + 0.2 * x * x + 0.6 * var
                price *= 1 + x
                r.append(x)
            rows.append((name, k, price))
        truth[name] = plain_garch(r, G.grid_points())
    rows += [("flat", k, 5.0) for k in range(40)] + [("one", 0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, k long, close double").withColumn("ts", F.timestamp_seconds(F.col("k") * 60))
    bars = df.select("symbol", "ts", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    got = {r.symbol: r for r in G.garch_fit(features(bars, ["returns"])).collect()}
    assert set(got) == {"long", "short"}
    for name, (a, b, ll, var) in truth.items():
        assert (got[name].alpha, got[name].beta) == (a, b)
        assert got[name].log_likelihood == pytest.approx(ll, rel=1e-9)
        assert got[name].forecast_variance == pytest.approx(var, rel=1e-9)
    with pytest.raises(ValueError):
        G.grid_points(betas=(0.3,))
