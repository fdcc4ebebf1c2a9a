"""Piecewise-linear trend with change points and daily seasonality: a ridge solved for each series.

``close ~ c0 + c1 t + sum d_k max(t - s_k, 0) + sum (a_j sin + b_j cos)(2 pi j phase)``, with ``t`` the place
of a bar between the first (0) and the last (1) of its series, knots ``s_k`` evenly over the first
``SPAN`` of it, and ``phase`` the time of day. Changes of slope and harmonics are shrunk by ``RIDGE``.

Between two knots and at one time of day every basis function is ``a + b t``. So the cross products of
a series follow from five sums for each (segment, time of day): one hash aggregate over the bars, combined before
the shuffle, and a table whose size does not depend on the number of rows. The d x d system of a
series is solved by Gauss-Jordan steps over arrays (positive definite, so without pivoting). No Python runs.

A series of one bar has ``t`` = 0 and a flat trend. Rows without a time or a value take no part in a fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import join_small

# The reference's forecaster takes 25 change points over the first 80 % and four daily harmonics.
KNOTS, SPAN, HARMONICS = 25, 0.8, 4
#: Weight of the squared changes and harmonics, and of the slope, which only keeps a series of one bar solvable.
RIDGE, SLOPE_RIDGE = 0.01, 1e-6


@dataclass(frozen=True)
class Basis:
    """Number of change points, share of the time they cover, number of daily harmonics."""

    knots: int = KNOTS
    span: float = SPAN
    harmonics: int = HARMONICS

    @property
    def size(self) -> int:
        return 2 + self.knots + 2 * self.harmonics

    def places(self) -> list[float]:
        return [self.span * k / self.knots for k in range(1, self.knots + 1)]

    def waves(self, phase: Column) -> list[Column]:
        return [g(F.lit(2.0 * math.pi * j) * phase) for j in range(1, self.harmonics + 1) for g in (F.sin, F.cos)]

    def trend(self, t: Column) -> list[Column]:
        return [F.lit(1.0), t, *[F.greatest(t - F.lit(s), F.lit(0.0)) for s in self.places()]]


def _phase(ts: str) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / F.lit(86400.0)


def _micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _placed(f: DataFrame, ends: DataFrame, by: list[str], ts: str) -> DataFrame:
    """``f`` with ``_t`` and ``_phase``."""
    t = F.coalesce(F.try_divide((_micros(ts) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    return join_small(f, ends, by).withColumns({"_t": t, "_phase": _phase(ts)})


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def solve(system: Column, size: int) -> Column:
    """The solution of a positive definite system given as an array of rows, each with its right side last."""

    def step(m, k):
        pivot = F.get(m, k)
        return F.transform(
            m,
            lambda row, i: F.when(i == k, F.transform(row, lambda v: v / F.get(row, k))).otherwise(F.zip_with(row, pivot, lambda v, p: v - p * (F.get(row, k) / F.get(pivot, k)))),
        )

    reduced = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), system, step)
    return F.transform(reduced, lambda row: F.get(row, F.lit(size)))


def fit_trend(f: DataFrame, basis: Basis = Basis(), by: tuple[str, ...] = ("symbol",), ts: str = "ts", value: str = "close") -> DataFrame:
    """One row for each series: ``_lo`` and ``_hi`` (its time span in microseconds), ``n`` and the coefficients ``coef``."""
    keys, d = list(by), basis.size
    rows = f.filter(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("_y"))
    ends = rows.groupBy(*keys).agg(F.min(_micros(ts)).alias("_lo"), F.max(_micros(ts)).alias("_hi"), F.count(F.lit(1)).alias("n"))
    r = _placed(rows, ends.drop("n"), keys, ts)
    segment = F.least(F.floor(F.col("_t") * F.lit(basis.knots / basis.span)), F.lit(basis.knots)).cast("int")
    cells = r.groupBy(*keys, segment.alias("_g"), "_phase").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_t").alias("_st"), F.sum(F.col("_t") * F.col("_t")).alias("_stt"), F.sum("_y").alias("_sy"), F.sum(F.col("_t") * F.col("_y")).alias("_sty")
    )
    active = [F.col("_g") >= k for k in range(1, basis.knots + 1)]
    flat = [F.lit(1.0), F.lit(0.0), *[F.when(on, F.lit(-s)).otherwise(0.0) for on, s in zip(active, basis.places(), strict=True)], *basis.waves(F.col("_phase"))]
    steep = [F.lit(0.0), F.lit(1.0), *[on.cast("double") for on in active], *[F.lit(0.0)] * (2 * basis.harmonics)]
    cells = cells.withColumns({"_a": F.array(*flat), "_b": F.array(*steep)})

    def products(i):
        a, b = F.get("_a", i), F.get("_b", i)
        row = F.zip_with("_a", "_b", lambda c, e: a * c * F.col("_n") + (a * e + b * c) * F.col("_st") + b * e * F.col("_stt"))
        return F.concat(row, F.array(a * F.col("_sy") + b * F.col("_sty")))

    each = cells.select(*keys, F.posexplode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), products))).alias("_ij", "_v"))
    i, j = F.floor(F.col("_ij") / (d + 1)), F.col("_ij") % (d + 1)
    own = F.when(i == j, F.when(i == 0, 0.0).when(i == 1, SLOPE_RIDGE).otherwise(RIDGE)).otherwise(0.0)
    sums = each.groupBy(*keys, "_ij").agg(F.sum("_v").alias("_v")).withColumn("_v", F.col("_v") + own)
    flat_sums = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_ij", "_v"))).alias("_m"))  # d (d + 1) numbers
    system = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: F.transform(F.slice("_m", k * (d + 1) + 1, F.lit(d + 1)), lambda e: e["_v"]))
    return flat_sums.select(*keys, solve(system, d).alias("coef")).join(ends, keys)


def components(f: DataFrame, fit: DataFrame, basis: Basis = Basis(), by: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """``f`` with ``trend``, ``seasonal`` and ``fitted`` of each row, also for times beyond the fit."""
    n = 2 + basis.knots
    r = _placed(f, fit.select(*by, "_lo", "_hi", "coef"), list(by), ts)
    trend = _dot(F.slice("coef", 1, n), F.array(*basis.trend(F.col("_t"))))
    seasonal = _dot(F.slice("coef", n + 1, 2 * basis.harmonics), F.array(*basis.waves(F.col("_phase")))) if basis.harmonics else F.lit(0.0)
    r = r.withColumns({"trend": trend, "seasonal": seasonal}).withColumn("fitted", F.col("trend") + F.col("seasonal"))
    return r.drop("_lo", "_hi", "coef", "_t", "_phase")


def change_points(fit: DataFrame, basis: Basis = Basis(), by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row for each series and knot: ``knot`` (from 1), ``at`` (its time) and ``change`` of slope there, over the whole span."""
    k = fit.select(*by, "_lo", "_hi", F.posexplode(F.slice("coef", 3, basis.knots)).alias("_k", "change"))
    at = F.col("_lo") + F.round((F.col("_k") + 1) * F.lit(basis.span / basis.knots) * (F.col("_hi") - F.col("_lo"))).cast("long")
    return k.select(*by, (F.col("_k") + 1).alias("knot"), F.timestamp_micros(at).alias("at"), "change")


def trend_forecast(f: DataFrame, bar: str = "1 hour", basis: Basis = Basis()) -> DataFrame:
    """The fitted curve one bar after the last of each series, and whether it lies above the last close."""
    fit = fit_trend(f, basis)
    last = f.filter(F.col("close").isNotNull()).groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.max_by("close", "ts").alias("close"))
    ahead = last.withColumn("next_ts", F.col("last_ts") + F.expr(f"INTERVAL {bar}"))
    out = components(ahead, fit, basis, ts="next_ts")
    return out.select("symbol", "next_ts", "close", "trend", "seasonal", F.col("fitted").alias("forecast"), F.when(F.col("fitted") > F.col("close"), "up").otherwise("down").alias("direction"))
