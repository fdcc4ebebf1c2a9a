"""Report shaping: forecasts from the latest bar, text descriptions, label formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def format_trend(trend: Column) -> Column:
    """'strong_uptrend' -> 'Strong Uptrend' (first underscore to a space, words capitalised)."""
    return F.initcap(F.regexp_replace(trend, "^([^_]*)_", "$1 "))


def format_datetime(ts: Column) -> Column:
    return F.date_format(ts, TS_FORMAT)


def forecast_compound(latest: DataFrame, r: str, vol: str, steps: int = 10, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """From one row per series (close, ts, expected return ``r``, volatility ``vol``):
    ``steps`` rows of close * (1 + r)^i with bounds close * (1 + r +- vol)^i, dated
    ts + i days."""
    x = latest.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    i = F.col("step").cast("double")
    c, rr, vv = F.col("close"), F.col(r), F.col(vol)
    return x.select(
        *keys,
        "step",
        format_datetime(F.col("ts") + F.make_dt_interval(days=F.col("step"))).alias("date"),
        (c * F.pow(1.0 + rr, i)).alias("forecast"),
        (c * F.pow(1.0 + rr + vv, i)).alias("upper_bound"),
        (c * F.pow(1.0 + rr - vv, i)).alias("lower_bound"),
    )


def next_timestamp(latest: DataFrame, minutes: int = 10, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last bar time + ``minutes`` (data time, not the wall clock), formatted."""
    return latest.select(*keys, format_datetime(F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))).alias("next_timestamp"))


def describe_market(stats: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One line of text per series from the statistics of its bars (2 decimals)."""
    text = F.format_string(
        "%d bars, close %.2f (%.2f%% since the first bar); volume %s; phase %s; "
        "share of volume in rising bars %.2f, in falling bars %.2f",
        F.col("n_bars"),
        F.col("current_price"),
        F.col("price_change"),
        F.col("volume_trend"),
        F.col("market_phase"),
        F.col("buying_pressure"),
        F.col("selling_pressure"),
    )
    return stats.select(*keys, text.alias("description"))
