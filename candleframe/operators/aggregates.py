"""Per-series aggregates and latest-row market context.

All are ``groupBy(symbol).agg(...)``: partial aggregation runs before the shuffle, so a
symbol holding a third of the rows costs one pre-reduced row per map task. "Last k rows"
aggregates use the series row number against the series count (no whole-series window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import series_counts
from .joins import join_small
from .series import RN

C, H, L, O, V = "close", "high", "low", "open", "volume"


def _div(a, b):
    return F.try_divide(a, b)


def pressure_range(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Volume-weighted close location: buy = sum((C-L)V)/sum(V), sell = sum((H-C)V)/sum(V),
    both normalised by their sum; net = buy - sell."""
    g = bars.groupBy(*by).agg(
        _div(F.sum((F.col(C) - F.col(L)) * F.col(V)), F.sum(V)).alias("_buy"),
        _div(F.sum((F.col(H) - F.col(C)) * F.col(V)), F.sum(V)).alias("_sell"),
    )
    tot = F.col("_buy") + F.col("_sell")
    return g.select(
        *by,
        _div(F.col("_buy"), tot).alias("buying_pressure"),
        _div(F.col("_sell"), tot).alias("selling_pressure"),
        (_div(F.col("_buy"), tot) - _div(F.col("_sell"), tot)).alias("net_pressure"),
    )


def pressure_body(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Volume of up bars (C>O) vs down bars (C<O): shares, ratio, conditional means."""
    up, dn = F.col(C) > F.col(O), F.col(C) < F.col(O)
    g = bars.groupBy(*by).agg(
        F.sum(F.when(up, F.col(V)).otherwise(0.0)).alias("_bv"),
        F.sum(F.when(dn, F.col(V)).otherwise(0.0)).alias("_sv"),
        F.avg(F.when(up, F.col(V))).alias("buying_volume_avg"),
        F.avg(F.when(dn, F.col(V))).alias("selling_volume_avg"),
    )
    tot = F.col("_bv") + F.col("_sv")
    return g.select(
        *by,
        _div(F.col("_bv"), tot).alias("buying_pressure"),
        _div(F.col("_sv"), tot).alias("selling_pressure"),
        _div(F.col("_bv") - F.col("_sv"), tot).alias("pressure_ratio"),
        "buying_volume_avg",
        "selling_volume_avg",
    )


def money_flow(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    tp = (F.col(H) + F.col(L) + F.col(C)) / 3.0
    return bars.groupBy(*by).agg(F.sum(tp * F.col(V)).alias("net_money_flow"))


def _tail_flag(indexed: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    j = join_small(indexed, series_counts(indexed, by), list(by), "inner")
    return j.withColumn("_tail", F.col(RN) >= F.col("_n") - k)


def volume_metrics(features: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """average volume; volume trend from the mean of pct_change(V); mean of the last 20 /
    mean; last volume_std / volume_sma. ``features`` needs _rn, volume_change,
    volume_std, volume_sma."""
    j = _tail_flag(features, 20, by)
    g = j.groupBy(*by).agg(
        F.avg(V).alias("average_volume"),
        F.avg("volume_change").alias("_mchg"),
        F.avg(F.when(F.col("_tail"), F.col(V))).alias("_tail_avg"),
        F.max_by(_div(F.col("volume_std"), F.col("volume_sma")), F.col(RN)).alias("volume_volatility"),
    )
    return g.select(
        *by,
        "average_volume",
        F.when(F.col("_mchg") > 0, "increasing").otherwise("decreasing").alias("volume_trend"),
        _div(F.col("_tail_avg"), F.col("average_volume")).alias("volume_strength"),
        "volume_volatility",
    )


def volume_vs_100(features: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Over the last 100 bars: mean volume, last volume vs that mean (label and ratio)."""
    j = _tail_flag(features, 100, by).filter(F.col("_tail"))
    g = j.groupBy(*by).agg(F.avg(V).alias("avg_volume"), F.max_by(F.col(V), F.col(RN)).alias("_last"))
    return g.select(
        *by,
        "avg_volume",
        F.when(F.col("_last") > F.col("avg_volume"), "increasing").otherwise("decreasing").alias("volume_trend"),
        _div(F.col("_last"), F.col("avg_volume")).alias("volume_strength"),
    )


def trend_metrics(features: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """mean return; sample std of H/L; mean of last 20 closes / mean close; mean first and
    second difference of close. ``features`` needs _rn, returns, delta_close."""
    j = _tail_flag(features, 20, by)
    j = j.withColumn("_d2", F.col("delta_close") - F.col("prev_delta_close"))
    g = j.groupBy(*by).agg(
        F.avg("returns").alias("price_momentum"),
        F.stddev_samp(_div(F.col(H), F.col(L))).alias("volatility"),
        F.avg(F.when(F.col("_tail"), F.col(C))).alias("_tail_c"),
        F.avg(C).alias("_mean_c"),
        F.avg("delta_close").alias("price_velocity"),
        F.avg("_d2").alias("price_acceleration"),
    )
    return g.select(
        *by,
        "price_momentum",
        "volatility",
        _div(F.col("_tail_c"), F.col("_mean_c")).alias("trend_strength"),
        "price_velocity",
        "price_acceleration",
    )


def latest_snapshot(features: DataFrame, cols: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Values of ``cols`` at the last row of each series (``max_by`` on the row number)."""
    g = features.groupBy(*by).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(RN)).alias("_l"))
    return g.select(*by, "_l.*")


def total_change(bars: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """last close / first close - 1, in percent."""
    g = bars.groupBy(*by).agg(F.min_by(C, ts).alias("_first"), F.max_by(C, ts).alias("_last"))
    return g.select(*by, "_last", ((_div(F.col("_last"), F.col("_first")) - 1.0) * 100.0).alias("price_change_pct")).withColumnRenamed(
        "_last", "latest_price"
    )


def median_sq_return(features: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Exact median of squared returns per series (band-based, no whole-group buffer)."""
    from .quantiles import exact_median

    sq = features.select(*by, (F.col("returns") * F.col("returns")).alias("_sq"))
    return exact_median(sq, by, "_sq", "median_sq_return")


def market_phase_col(price, sma20, sma50):
    return (
        F.when((price > sma20) & (sma20 > sma50), "strong_uptrend")
        .when((price < sma20) & (sma20 < sma50), "strong_downtrend")
        .when((sma20 > sma50) & (price < sma20), "weak_uptrend")
        .when((sma20 < sma50) & (price > sma20), "weak_downtrend")
        .otherwise("sideways")
    )
