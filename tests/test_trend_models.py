"""Change points, boosting, isolation forest, kernel map, total order and roll-up against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleframe.operators import boosting as BO
from candleframe.operators import isolation as IS
from candleframe.operators import kernel as KE
from candleframe.operators import order as OD
from candleframe.operators import trend as TR


def plain_basis(t, phase, b):
    waves = [g(2 * math.pi * j * phase) for j in range(1, b.harmonics + 1) for g in (math.sin, math.cos)]
    return [1.0, t, *[max(t - s, 0.0) for s in b.places()], *waves]


@pytest.mark.parametrize("basis", [TR.Basis(), TR.Basis(5, 0.9, 2)])
def test_trend_equals_least_squares_and_finds_the_break(spark, basis):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for symbol, n, step, knot in (("a", 900, 3600, 12), ("b", 300, 600, 3)):
        at = basis.span * min(knot, basis.knots - 1) / basis.knots
        t = np.arange(n) / (n - 1)
        phase = (np.arange(n) * step % 86400) / 86400
        y = 50 + 3 * t + 400 * np.maximum(t - at, 0) + 2 * np.sin(2 * math.pi * phase) + rng.standard_normal(n) * 0.1
        rows += [(symbol, k * step, float(y[k])) for k in range(n)]
        x = np.array([plain_basis(t[k], phase[k], basis) for k in range(n)])
        own = np.diag([0.0, TR.SLOPE_RIDGE, *[TR.RIDGE] * (basis.size - 2)])
        want[symbol] = np.linalg.solve(x.T @ x + own, x.T @ y), x, min(knot, basis.knots - 1)
    f = spark.createDataFrame(rows, "symbol string, s long, close double").select("symbol", F.timestamp_seconds("s").alias("ts"), "close")
    fit = TR.fit_trend(f.repartition(5), basis)
    for r in fit.collect():
        assert np.allclose(r.coef, want[r.symbol][0], rtol=1e-6, atol=1e-6)
    parts = TR.components(f, fit, basis).orderBy("symbol", "ts").collect()
    for symbol, (coef, x, knot) in want.items():
        own = [r for r in parts if r.symbol == symbol]
        assert np.allclose([r.fitted for r in own], x @ coef, atol=1e-6)
        assert np.allclose([r.trend for r in own], x[:, : 2 + basis.knots] @ coef[: 2 + basis.knots], atol=1e-6)
        largest = max(TR.change_points(fit, basis).filter(F.col("symbol") == symbol).collect(), key=lambda r: abs(r.change))
        assert abs(largest.knot - knot) <= 1


def test_trend_of_one_bar_nothing_and_nulls(spark):
    f = spark.createDataFrame([("a", 3600, 5.0), ("a", None, 9.0), ("a", 7200, None)], "symbol string, s long, close double").select("symbol", F.timestamp_seconds("s").alias("ts"), "close")
    fit = TR.fit_trend(f)
    (one,) = TR.components(f.filter("close = 5"), fit).collect()
    assert one.fitted == pytest.approx(5.0) and fit.first().n == 1
    (ahead,) = TR.trend_forecast(f).collect()
    assert ahead.forecast is not None and ahead.close == 5.0
    assert TR.trend_forecast(f.limit(0)).isEmpty()


def plain_rounds(x, y, cuts, rounds):
    """Boosting by weights that are kept and updated, over the same cuts."""
    w, out = np.ones(len(y)) / len(y), []
    for _ in range(rounds):
        best = None
        for k, own in enumerate(cuts):
            for c in own:
                left = x[:, k] <= c
                gini, votes, miss = 0.0, [], np.zeros(len(y), bool)
                for side in (left, ~left):
                    p, n = w[side & (y > 0)].sum(), w[side & (y < 0)].sum()
                    gini += p * n / (p + n) if p + n else 0.0
                    votes.append(1.0 if p > n else -1.0)
                    miss |= side & (y != votes[-1])
                if best is None or round(gini, 12) < best[0]:
                    best = (round(gini, 12), k, c, *votes, miss)
        _, k, c, left, right, miss = best
        error = w[miss].sum()
        alpha = math.log((1 - error) / error)
        out.append((k, c, left, right, alpha))
        w = w * np.exp(alpha * miss)
        w /= w.sum()
    return out


def test_boosting_equals_kept_weights_and_learns(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 3))
    y = np.where(x[:, 0] + x[:, 1] + 0.3 * rng.standard_normal(500) > 0, 1.0, -1.0)
    df = spark.createDataFrame([(*map(float, x[k]), float(y[k] > 0)) for k in range(500)], "a double, b double, c double, label double")
    stumps = BO.fit_boosted(df, ["a", "b", "c"], rounds=15)
    cuts = BO.cut_points(df, ["a", "b", "c"])
    want = plain_rounds(x, y, cuts, 15)
    assert [("abc".index(s.column), s.cut, s.left, s.right) for s in stumps] == [w[:4] for w in want]
    assert np.allclose([s.alpha for s in stumps], [w[4] for w in want])
    scored = BO.score_boosted(df, stumps)
    assert scored.filter("prediction = label").count() > 440 > BO.score_boosted(df, stumps[:1]).filter("prediction = label").count()
    assert scored.filter("(prob_up > 0.5) != (prediction = 1)").isEmpty()


def test_boosting_odd_inputs(spark):
    one = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "a double, label double")
    assert BO.fit_boosted(one, ["a"], rounds=3) == [] == BO.fit_boosted(one.limit(0), ["a"], rounds=3)
    assert {(r.prob_up, r.prediction) for r in BO.score_boosted(one, []).collect()} == {(0.5, 0.0)}
    split = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (None, 1.0)], "a double, label double")
    (stump,) = BO.fit_boosted(split, ["a"], rounds=9)  # perfect at once
    assert (stump.cut, stump.left, stump.right, stump.alpha) == (1.0, -1.0, 1.0, 1.0)
    assert [r.prediction for r in BO.score_boosted(split, [stump]).orderBy("a").collect()] == [1.0, 0.0, 1.0]


def plain_path(row, tree):
    _, dim, cut, child, path = tree
    node = 0
    while child[node] >= 0:
        node = child[node] + int(row[dim[node]] > cut[node])
    return path[node]


def test_isolation_forest(spark):
    rng = np.random.default_rng(2)
    x = np.vstack((rng.standard_normal((600, 3)), [[8.0, 8, 8], [-9, 7, 0], [0, 0, 12]]))
    rows = [(k, x[k].tolist()) for k in range(len(x))] + [(900, None), (901, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "key long, x array<double>")
    forest = IS.fit_forest(df.repartition(7), "key", trees=40, sample=200)
    again = IS.fit_forest(df.coalesce(1), "key", trees=40, sample=200)
    assert len(forest) == 40 and all(np.array_equal(a, b) for s, t in zip(forest, again, strict=True) for a, b in zip(s[1:], t[1:], strict=True))
    assert 150 < np.mean([t[0] for t in forest]) < 250
    got = {r.key: r.anomaly for r in IS.score_forest(df, forest).collect()}
    assert got[900] is None and got[901] is None
    for k in (0, 17, 600, 602):
        mean = np.mean([plain_path(x[k], t) / float(IS.mean_path(t[0])) for t in forest])
        assert got[k] == pytest.approx(2.0**-mean)
    assert set(sorted((k for k in got if got[k] is not None), key=got.get)[-3:]) == {600, 601, 602}
    scored = IS.score_forest(df, forest)
    flagged = IS.outliers(scored, scored).filter("inlier = 0").count()
    assert 50 <= flagged <= 61
    assert IS.fit_forest(df.limit(0), "key") == [] and IS.score_forest(df, []).filter("anomaly IS NOT NULL").isEmpty()


def test_kernel_map_and_ring(spark):
    rng = np.random.default_rng(4)
    w, b = KE.fourier_weights(2, 0.5, 2000)
    x = rng.standard_normal((30, 2))
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(30)], "k long, x array<double>").repartition(3)
    z = np.array([r.z for r in df.select("k", KE.fourier_features(F.col("x"), w, b).alias("z")).orderBy("k").collect()])
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.12
    p = rng.uniform(-2, 2, (900, 2))
    ring = [(float(a), float(c), float(0.8 < math.hypot(a, c) < 1.7), k % 4 == 0) for k, (a, c) in enumerate(p)]
    panel = spark.createDataFrame(ring, "a double, b double, label double, is_test boolean")
    out = KE.rbf_svc(panel, ["a", "b"], gamma=1.0, n=150)
    right = out.filter("prediction = label").count() / out.count()
    most = max(np.mean([r[2] for r in ring[::4]]), 1 - np.mean([r[2] for r in ring[::4]]))
    assert right > 0.88 > most + 0.2
    assert out.filter("prob_up < 0 OR prob_up > 1").isEmpty()


def test_total_order(spark):
    rows = [(k * 7919 % 1000 // 3, f"s{k % 5}", k) for k in range(1000)] + [(None, "s0", -1)]
    df = spark.createDataFrame(rows, "t int, s string, k int").repartition(6)
    got = OD.total_order(df, ["t", "s", "k"]).orderBy("row").collect()
    assert [r.row for r in got] == list(range(1001))
    assert [r.k for r in got] == [r[2] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))]
    assert OD.total_order(df.limit(0), ["t"]).isEmpty()


def test_signal_rollup(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, -1), ("b", -1, None)], "symbol string, sig_x int, sig_y int")
    got = {(r.symbol, r.strategy, r.level): (r.n_bars, r.n_buy, r.n_sell) for r in OD.signal_rollup(df, ["x", "y"]).collect()}
    assert got == {("a", "x", 0): (2, 2, 0), ("a", "y", 0): (2, 0, 1), ("b", "x", 0): (1, 0, 1), ("b", "y", 0): (1, 0, 0), ("a", None, 1): (4, 2, 1), ("b", None, 1): (2, 0, 1), (None, None, 3): (6, 2, 2)}
