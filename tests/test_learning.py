"""Closed-form ridge against numpy, the hashed split, label names, and a planted signal in the MLlib models."""

import numpy as np
import pytest
from candleframe.functions.feature_sets import FEATURE_SETS, FEATURES_7, FEATURES_8, FEATURES_33
from candleframe.functions.signals import PAIRED_RULES
from candleframe.operators import consensus as CS
from candleframe.operators import labels as LB
from candleframe.operators import linear as LI
from candleframe.operators import ml as ML
from pyspark.sql import functions as F


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1.0, 1e6, 1e-3] + [5.0, 1e8, 0.0]
    y = 2.0 * x[:, 0] - 3e-6 * x[:, 1] + rng.normal(size=300)
    rows = [(*map(float, r), 7.0, float(t)) for r, t in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, (1.0, None, 1.0, 7.0, 1.0)], "a double, b double, c double, flat double, y double")
    m = LI.fit_ridge(df, ["a", "b", "c", "flat"], "y", alpha=2.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(m.weights[:3], want, rtol=1e-8) and m.weights[3] == 0.0 and np.isclose(m.intercept, y.mean())
    got = [r.s for r in df.na.drop().select(m.score().alias("s")).collect()]
    assert np.allclose(got, y.mean() + z @ want, rtol=1e-8)
    with pytest.raises(ValueError):
        LI.fit_ridge(df.limit(0), ["a"], "y")


def test_random_split_depends_on_the_key_alone(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    a = {(r.k, r.is_test) for r in LB.split_random(df, [F.col("k")]).collect()}
    b = {(r.k, r.is_test) for r in LB.split_random(df.repartition(7).orderBy(F.desc("k")), [F.col("k")]).collect()}
    other = {(r.k, r.is_test) for r in LB.split_random(df, [F.col("k")], seed=7).collect()}
    assert a == b != other and 0.19 < sum(t for _, t in a) / 20_000 < 0.21


def test_directions_and_feature_sets():
    assert CS.directions(3)[0] == "uptrend" and len(CS.directions(5)) == 5 and CS.directions(2) == ["class_0", "class_1"]
    assert list(FEATURE_SETS) == [n for n, _, _ in PAIRED_RULES] and {len(v) for v in FEATURE_SETS.values()} == {5}
    assert (len(set(FEATURES_33)), len(set(FEATURES_8)), len(set(FEATURES_7))) == (33, 8, 7)


def test_models_find_a_planted_signal(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(900):
        x = rng.normal(size=3)
        rows.append(("A", k, *map(float, x), float(x[0] - 0.5 * x[1] + 0.3 * rng.normal() > 0), k >= 700))
    p = spark.createDataFrame(rows, "symbol string, ts long, x double, y double, w double, label double, is_test boolean")
    cols = ["x", "y", "w"]
    preds, _ = ML.bakeoff(p, cols)
    preds = preds.select("model", "prediction", "label").unionByName(LI.classify_ridge(p, cols).select(F.lit("Ridge").alias("model"), "prediction", "label"))
    for quadratic in (False, True):
        preds = preds.unionByName(ML.discriminant(p, cols, quadratic).select("model", "prediction", "label"))
    hits = {r.model: r.hit for r in preds.groupBy("model").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("hit")).collect()}
    assert len(hits) == 14 and min(hits.values()) > 0.8, hits
