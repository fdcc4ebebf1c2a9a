"""Ticks -> OHLCV bars and bar -> coarser bar resampling.

Both are one aggregation keyed by (symbol, bucket): partial aggregation runs map-side, so
a hot symbol is spread over all its buckets and pre-reduced before the shuffle.
open/close use ``min_by``/``max_by`` over the tick order key; a composite (ts, seq) key
makes Spark plan it sort-based, a single ``ts`` key hash-based.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order_key(order: Sequence[str]) -> Column:
    # A single key keeps the aggregate hash-based; a composite key (ts, seq) is needed
    # when timestamps repeat and makes Spark plan a sort-based aggregate.
    return F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])


def fixture_bars(
    ticks: DataFrame,
    period: str = "1 hour",
    *,
    symbol: str = "symbol",
    ts: str = "ts",
    price: str = "price",
    qty: str = "qty",
    order: Sequence[str] = ("ts", "seq"),
) -> DataFrame:
    """OHLCV bars: one row per (symbol, bucket start) that holds at least one tick."""
    key = _order_key(order)
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.window(F.col(ts), period).start.alias("ts"))
        .agg(
            F.min_by(F.col(price), key).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(F.col(price), key).alias("close"),
            F.sum(qty).alias("volume"),
        )
    )


def resample_bars(bars: DataFrame, period: str, *, ts: str = "ts") -> DataFrame:
    """Coarser bars (e.g. hourly -> daily) from finer bars: open of first, close of last."""
    return (
        bars.groupBy("symbol", F.window(F.col(ts), period).start.alias("ts"))
        .agg(
            F.min_by("open", F.col(ts)).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", F.col(ts)).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n_bars"),
        )
    )
