"""Per-bar market context classifiers. Row-local CASE expressions over the
feature frame; NULL inputs fall through to the neutral branch as NaN does in pandas.

The thresholds and labels in the CASE expressions are fixed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(name: str) -> Column:
    return F.col(name)


def trend_context() -> Column:
    """sma10/20/50 stacking and 5-bar momentum (close change over 5 bars divided by the
    close 4 bars back, in %, as the reference computes it)."""
    c, s10, s20, s50 = _c("close"), _c("sma_10"), _c("sma_20"), _c("sma_50")
    mom = F.try_divide(c - _c("close_lag5"), _c("close_lag4")) * 100.0
    return (
        F.when((c > s10) & (s10 > s20) & (s20 > s50) & (mom > 0.5), "strong_uptrend")
        .when((c < s10) & (s10 < s20) & (s20 < s50) & (mom < -0.5), "strong_downtrend")
        .when((c > s20) & (mom > 0), "uptrend")
        .when((c < s20) & (mom < 0), "downtrend")
        .otherwise("neutral")
    )


def volume_context() -> Column:
    """Volume spike confirmed by a rising short volume average."""
    return F.coalesce(
        (_c("volume_sma_5") > _c("volume_sma")) & (F.try_divide(_c("volume"), _c("volume_sma")) > 1.5), F.lit(False)
    )


def rsi_context() -> Column:
    """Simple RSI and the last tick direction -> strong_buy .. strong_sell."""
    rsi = _c("rsi_simple")
    higher = F.coalesce(_c("close") > _c("prev_close"), F.lit(False))
    return (
        F.when((rsi < 30) & higher, "strong_buy")
        .when((rsi > 70) & ~higher, "strong_sell")
        .when(rsi < 40, "buy")
        .when(rsi > 60, "sell")
        .otherwise("neutral")
    )


def recent_trend() -> Column:
    """EMA5 and EMA20 both rising -> up, both not rising -> down, else NULL."""
    r5 = F.coalesce(_c("ema_5") > _c("prev_ema_5"), F.lit(False))
    r20 = F.coalesce(_c("ema_20") > _c("prev_ema_20"), F.lit(False))
    return F.when(r5 & r20, "up").when(~r5 & ~r20, "down")


def volume_confirmed() -> Column:
    return F.coalesce(_c("volume_ratio") > 1.0, F.lit(False))


def rsi_extreme() -> Column:
    return F.when(_c("rsi") < 30, "up").when(_c("rsi") > 70, "down")


def market_phase() -> Column:
    c, s20, s50 = _c("close"), _c("sma_20"), _c("sma_50")
    return (
        F.when((c > s20) & (s20 > s50), "strong_uptrend")
        .when((c < s20) & (s20 < s50), "strong_downtrend")
        .when((s20 > s50) & (c < s20), "weak_uptrend")
        .when((s20 < s50) & (c > s20), "weak_downtrend")
        .otherwise("sideways")
    )


def ui_bands() -> dict[str, Column]:
    """Display bands of the UI as data: volatility level, volume strength, trend strength."""
    vn, vr, adx = _c("volatility_norm"), _c("volume_ratio"), _c("adx")
    return {
        "volatility_band": F.when(vn > 50, "high").when(vn > 30, "medium").otherwise("low"),
        "volume_band": F.when(vr > 1.5, "high").when(vr < 0.5, "low").otherwise("normal"),
        "trend_band": F.when(adx > 25, "strong").otherwise("weak"),
    }


#: The feature columns that each output reads.
CONTEXT_INPUTS: dict[str, tuple[str, ...]] = {
    "trend_context": ("sma_10", "sma_20", "sma_50", "close_lag5", "close_lag4"),
    "volume_context": ("volume_sma_5", "volume_sma"),
    "rsi_context": ("rsi_simple", "prev_close"),
    "recent_trend": ("ema_5", "prev_ema_5", "ema_20", "prev_ema_20"),
    "volume_confirmed": ("volume_ratio", "volume_sma"),
    "rsi_signal": ("rsi",),
    "market_phase": ("sma_20", "sma_50"),
    "volatility_band": ("volatility_norm",),
    "volume_band": ("volume_ratio", "volume_sma"),
    "trend_band": ("adx",),
}


def with_context(f: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """Add the named outputs; ``f`` needs their ``CONTEXT_INPUTS`` only."""
    built = {
        "trend_context": trend_context,
        "volume_context": volume_context,
        "rsi_context": rsi_context,
        "recent_trend": recent_trend,
        "volume_confirmed": volume_confirmed,
        "rsi_signal": rsi_extreme,
        "market_phase": market_phase,
    }
    return f.withColumns({name: built[name]() if name in built else ui_bands()[name] for name in outputs})
