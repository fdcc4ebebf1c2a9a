"""Ridge regression and classification in closed form from one aggregate pass.

The pass returns means, deviations and covariances of the features and the target: O(d^2) numbers,
whatever the number of rows, with map-side partial sums. The d x d system is solved on the driver, and a score
is a column expression over the row. The penalty is on the weights of the standardised features and
not on the intercept; a feature without spread on the train rows gets no weight.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ridge:
    """``intercept + sum(weight * (x - mean) / spread)``."""

    cols: tuple[str, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for c, m, s, w in zip(self.cols, self.means, self.spreads, self.weights, strict=True):
            total = total + F.lit(w) * ((F.col(c).cast("double") - F.lit(m)) / F.lit(s))
        return total


def fit_ridge(train: DataFrame, cols: Sequence[str], target: str, alpha: float = 1.0) -> Ridge:
    """The weights that minimise the squared error plus ``alpha`` times their squares; rows with a null take no part."""
    cols, d = tuple(cols), len(cols)
    rows = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(target).cast("double").alias("y")).na.drop()
    aggs = [F.count("*").alias("n"), F.avg("y").alias("my")]
    aggs += [F.avg(f"x{i}").alias(f"m{i}") for i in range(d)] + [F.covar_pop(f"x{i}", "y").alias(f"b{i}") for i in range(d)]
    aggs += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    r = rows.agg(*aggs).first()  # one row of O(d^2) numbers
    if not r.n:
        raise ValueError("no row without a null to fit on")
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    spread = np.sqrt(np.diag(cov))
    flat = spread <= 1e-12 * np.maximum(np.abs([r[f"m{i}"] for i in range(d)]), 1e-300)
    spread[flat] = 1.0
    z = cov / np.outer(spread, spread)
    b = np.array([r[f"b{i}"] for i in range(d)]) / spread
    z[flat], z[:, flat], b[flat] = 0.0, 0.0, 0.0
    w = np.linalg.solve(r.n * z + alpha * np.eye(d) + np.diag(flat.astype(float)), r.n * b)
    return Ridge(cols, tuple(float(r[f"m{i}"]) for i in range(d)), tuple(spread.tolist()), tuple(w.tolist()), float(r.my))


def classify_ridge(p: DataFrame, cols: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Test rows of a panel with ``margin`` and ``prediction``: a ridge fit of the label as -1 or 1, up where it is above 0."""
    signed = p.withColumn("_signed", F.col("label") * 2.0 - 1.0)
    model = fit_ridge(signed.filter(~F.col("is_test")), cols, "_signed", alpha)
    return p.filter("is_test").withColumn("margin", model.score()).withColumn("prediction", (F.col("margin") > 0).cast("double"))
