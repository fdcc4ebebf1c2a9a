"""Kernel support-vector classifier: random Fourier features as column expressions, then a linear SVC.

``exp(-gamma |x - y|^2)`` is the mean of ``2 cos(w.x + b) cos(w.y + b)`` over normal ``w`` of variance
``2 gamma`` and uniform ``b``; ``FEATURES`` draws give a map whose inner products approximate the kernel with an
error near ``1 / sqrt(FEATURES)``. The map is an array of expressions over the standardised columns, so no kernel
matrix exists and a fit grows with the rows, not with their square. The draws are one folded literal: written out,
200 sums of 12 products took minutes to plan and compile. ``gamma`` is ``1 / d`` for standardised columns.
Probabilities come from a logistic fit on the margins of the train rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import standardised

FEATURES, SEED, C = 200, 42, 1.0


def fourier_weights(d: int, gamma: float, n: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (n x d) and phases of the map."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d)) * math.sqrt(2.0 * gamma), rng.uniform(0.0, 2.0 * math.pi, n)


def fourier_features(x: Column, w: np.ndarray, b: np.ndarray) -> Column:
    """The map of an array column, as an array of the same length as ``b``."""
    draws = F.from_json(F.lit(json.dumps([{"w": own, "b": phase} for own, phase in zip(w.tolist(), b.tolist(), strict=True)])), "array<struct<w:array<double>,b:double>>")
    angle = lambda k: F.aggregate(F.zip_with(k["w"], x, lambda u, v: u * v), k["b"], lambda s, v: s + v)
    return F.transform(draws, lambda k: F.lit(math.sqrt(2.0 / len(b))) * F.cos(angle(k)))


def rbf_svc(panel: DataFrame, cols: Sequence[str], gamma: float | None = None, n: int = FEATURES, c: float = C, max_iter: int = 30, seed: int = SEED) -> DataFrame:
    """Test rows with ``margin``, ``prob_up`` and ``prediction``; ``panel`` holds ``label`` (0 or 1) and ``is_test``.

    Rows with a null among ``cols`` are left out. The train rows must hold both classes."""
    whole = panel.na.drop(subset=list(cols))
    w, b = fourier_weights(len(cols), gamma if gamma is not None else 1.0 / len(cols), n, seed)
    z = standardised(whole, cols).withColumn("features", array_to_vector(fourier_features(F.col("x"), w, b))).drop("x")
    train = z.filter(~F.col("is_test")).select("features", F.col("label").cast("double").alias("label")).persist()
    try:
        rows = train.count()
        svc = LinearSVC(maxIter=max_iter, regParam=1.0 / (c * max(rows, 1)), standardization=False).fit(train)
        margin = array_to_vector(F.array(vector_to_array("rawPrediction")[1]))
        calibrated = LogisticRegression(maxIter=25, featuresCol="m", rawPredictionCol="_r", probabilityCol="_p", predictionCol="_q").fit(svc.transform(train).select(margin.alias("m"), "label"))
    finally:
        train.unpersist()
    out = calibrated.transform(svc.transform(z.filter("is_test")).withColumn("m", margin))
    return out.withColumns({"margin": vector_to_array("m")[0], "prob_up": vector_to_array("_p")[1]}).drop("features", "rawPrediction", "m", "_r", "_p", "_q")
