"""GARCH(1,1) by variance targeting: every grid point of (alpha, beta) is one recurrence of the scan.

``var[t] = (1 - alpha - beta) * s2 + alpha * r[t-1]^2 + beta * var[t-1]``, with ``s2`` the mean squared
return of the series and ``var = s2`` at the first return. All grid points are columns of one linear
scan, so a series is read once whatever the grid's size and a hot symbol is spread over its blocks;
the Gaussian log-likelihoods are sums, and the point with the largest wins, the first on a tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import median_sq_return
from .joins import join_small
from .scan import Recurrence, linear_scan
from .series import RN, Layout, windowed

ALPHAS, BETAS = (0.03, 0.06, 0.1, 0.2), (0.6, 0.7, 0.8, 0.88)


def grid_points(alphas: Sequence[float] = ALPHAS, betas: Sequence[float] = BETAS) -> list[tuple[float, float]]:
    """(alpha, beta) of every stationary point; a beta below 0.55 would leave the scan's range."""
    if min(betas) < 0.55:
        raise ValueError("beta must be at least 0.55")
    return [(a, b) for a in alphas for b in betas if a + b < 1.0]


def garch_variances(f: DataFrame, points: Sequence[tuple[float, float]], layout: Layout | None = None) -> DataFrame:
    """``f`` with ``_r2`` (squared return), ``_s2`` (its mean) and the variance of each point as ``_var_<k>``.

    The first row of a series has no return and no variance; a null return later counts as zero."""
    layout = layout or Layout()
    by = list(layout.by)
    r2 = F.when(F.col(RN) > 0, F.coalesce(F.col("returns") * F.col("returns"), F.lit(0.0)))
    f = windowed(f.withColumn("_r2", r2), layout, 1, [[("_before", lambda w: F.lag("_r2").over(w))]])
    s2 = f.groupBy(*by).agg(F.avg("_r2").alias("_s2"))
    f = join_small(f, s2, by, "inner")
    rn = F.col(RN)
    recs = []
    for k, (alpha, beta) in enumerate(points):
        a = F.when(rn <= 1, F.lit(1.0)).otherwise(F.lit(beta))
        c = F.when(rn < 1, F.lit(0.0)).when(rn == 1, F.col("_s2")).otherwise(F.lit(1.0 - alpha - beta) * F.col("_s2") + F.lit(alpha) * F.col("_before"))
        recs.append(Recurrence(f"_var_{k}", a, c, rn >= 1))
    return linear_scan(f, layout, recs)


def garch_fit(f: DataFrame, points: Sequence[tuple[float, float]] | None = None, layout: Layout | None = None) -> DataFrame:
    """One row for each series: alpha, beta, log_likelihood and forecast_variance (of the next bar).

    A series without a return, or whose returns are all zero, has no row."""
    layout = layout or Layout()
    points = list(points or grid_points())
    v = garch_variances(f, points, layout).filter((F.col(RN) >= 1) & (F.col("_s2") > 0))
    sums = []
    for k, (alpha, beta) in enumerate(points):
        var = F.col(f"_var_{k}")
        ahead = F.lit(1.0 - alpha - beta) * F.col("_s2") + F.lit(alpha) * F.col("_r2") + F.lit(beta) * var
        sums += [(-0.5 * F.sum(F.log(var) + F.col("_r2") / var)).alias(f"_ll_{k}"), F.max_by(ahead, F.col(RN)).alias(f"_next_{k}")]
    g = v.groupBy(*layout.by).agg(*sums)
    tried = F.array(*[
        F.struct(F.round(F.col(f"_ll_{k}"), 6).alias("ll"), F.lit(-k).alias("k"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.col(f"_ll_{k}").alias("log_likelihood"), F.col(f"_next_{k}").alias("forecast_variance"))
        for k, (a, b) in enumerate(points)
    ])
    best = g.withColumn("_best", F.array_max(tried))
    return best.select(*layout.by, *[f"_best.{c}" for c in ("alpha", "beta", "log_likelihood", "forecast_variance")])


def garch_vote(f: DataFrame, points: Sequence[tuple[float, float]] | None = None, layout: Layout | None = None) -> DataFrame:
    """The next bar's variance against the median squared return: above -> 'up', else 'down'."""
    j = garch_fit(f, points, layout).join(median_sq_return(f), list((layout or Layout()).by))
    return j.withColumn("vote", F.when(F.col("forecast_variance") > F.col("median_sq_return"), "up").otherwise("down"))
