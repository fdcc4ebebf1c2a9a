"""AdaBoost over decision stumps as Spark aggregates (discrete boosting, two classes).

Every column is cut into at most ``BINS`` bins once, at quantiles of the train rows. A round is one
aggregate: weighted counts of each class for each (column, bin), combined before the shuffle, from which the
stump with the least weighted Gini impurity is read; ties go to the first column and the lowest cut. The weight
of a row is no stored state but an expression, ``exp(-y F / 2)`` with ``F`` the votes so far, so a round adds one
CASE to the plan and a lost executor costs only its part of the binned rows.

Only the (column, bin) sums reach the driver. A null column value falls in the last bin. With one class only,
or none, nothing is learned: every row gets probability 0.5 and prediction 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Rounds of the reference's model.
ROUNDS = 300


@dataclass(frozen=True)
class Stump:
    """``left`` (+1 or -1) where ``column <= cut``, else ``right``; its vote counts ``alpha``."""

    column: str
    cut: float
    left: float
    right: float
    alpha: float

    def vote(self) -> Column:
        return F.when(F.col(self.column) <= F.lit(self.cut), F.lit(self.alpha * self.left)).otherwise(F.lit(self.alpha * self.right))


def cut_points(train: DataFrame, cols: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Ascending cuts of each column: quantiles of the train rows that lie below its maximum."""
    shares = [k / bins for k in range(1, bins)]
    got = train.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q_{c}") for c in cols], *[F.max(c).alias(f"m_{c}") for c in cols]).first()
    return [sorted({float(v) for v in got[f"q_{c}"] or [] if v < got[f"m_{c}"]}) for c in cols]


def _bin(c: str, cuts: Sequence[float]) -> Column:
    if not cuts:
        return F.lit(0)
    below = F.size(F.filter(F.array(*[F.lit(v) for v in cuts]), lambda v: v < F.col(c)))
    return F.when(F.col(c).isNull(), F.lit(len(cuts))).otherwise(below)


def _best(pos: np.ndarray, neg: np.ndarray, n_cuts: Sequence[int]) -> tuple[int, int, float, float, float]:
    """(column, cut, left, right, weighted error) of the best stump; ``pos`` and ``neg`` are columns x bins."""
    best = None
    for k, cuts in enumerate(n_cuts):
        for b in range(cuts):
            lp, ln = pos[k, : b + 1].sum(), neg[k, : b + 1].sum()
            rp, rn = pos[k, b + 1 :].sum(), neg[k, b + 1 :].sum()
            gini = round(sum(p * n / (p + n) for p, n in ((lp, ln), (rp, rn)) if p + n > 0), 12)
            if best is None or gini < best[0]:
                best = (gini, k, b, 1.0 if lp > ln else -1.0, 1.0 if rp > rn else -1.0, float(min(lp, ln) + min(rp, rn)))
    return best[1:] if best else (-1, -1, 0.0, 0.0, 0.5)


def fit_boosted(train: DataFrame, cols: Sequence[str], label: str = "label", rounds: int = ROUNDS, bins: int = BINS) -> list[Stump]:
    """The stumps in order; fewer than ``rounds`` once one is perfect or none beats a coin."""
    cuts = cut_points(train, cols, bins)
    n_cuts = [len(c) for c in cuts]
    rows = train.filter(F.col(label).isNotNull()).select(F.when(F.col(label) > 0, 1.0).otherwise(-1.0).alias("_y"), *[_bin(c, own).alias(f"_b{k}") for k, (c, own) in enumerate(zip(cols, cuts, strict=True))])
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    stumps: list[Stump] = []
    votes = F.lit(0.0)
    try:
        for _ in range(rounds):
            w = F.exp(F.lit(-0.5) * F.col("_y") * votes)
            each = rows.select(w.alias("_w"), "_y", F.posexplode(F.array(*[f"_b{k}" for k in range(len(cols))])).alias("_k", "_b"))
            sums = each.groupBy("_k", "_b").agg(F.sum(F.when(F.col("_y") > 0, F.col("_w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("_y") < 0, F.col("_w")).otherwise(0.0)).alias("n")).collect()
            pos, neg = np.zeros((len(cols), bins)), np.zeros((len(cols), bins))
            for r in sums:  # columns x bins numbers
                pos[r["_k"], r["_b"]], neg[r["_k"], r["_b"]] = r["p"], r["n"]
            total = pos[0].sum() + neg[0].sum() if sums else 0.0
            if not total or not pos[0].sum() or not neg[0].sum():
                break
            k, b, left, right, error = _best(pos / total, neg / total, n_cuts)
            if k < 0 or error >= 0.5 - 1e-12:
                break
            alpha = math.log((1.0 - error) / error) if error > 1e-12 else 1.0
            stumps.append(Stump(cols[k], cuts[k][b], left, right, alpha))
            votes = votes + F.when(F.col(f"_b{k}") <= b, F.lit(alpha * left)).otherwise(F.lit(alpha * right))
            if error <= 1e-12:
                break
    finally:
        rows.unpersist()
    return stumps


def score_boosted(df: DataFrame, stumps: Sequence[Stump]) -> DataFrame:
    """``df`` with ``margin`` (mean vote, -1 to 1), ``prob_up`` (its logistic) and ``prediction``."""
    total = sum(s.alpha for s in stumps)
    votes = F.lit(0.0)
    for s in stumps:
        votes = votes + s.vote()
    margin = votes / F.lit(total) if total else F.lit(0.0)
    out = df.withColumn("margin", margin)
    return out.withColumns({"prob_up": 1.0 / (1.0 + F.exp(-F.col("margin"))), "prediction": (F.col("margin") > 0).cast("double")})
