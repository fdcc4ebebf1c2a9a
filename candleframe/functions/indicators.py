"""Technical indicators over bars, as lazy DataFrame stages.

Definitions are pinned in the repository's SURVEY §2.4 (the third-party indicator
library the reference calls is not part of its tree). Warm-up rows are NULL.
Division by zero gives NULL (``try_divide``) unless a rule below says otherwise.

Stages (each a single window exchange or a scan pass over the series layout):

    W1  rolling / lag over OHLCV                      (halo 120)
    S1  recurrences over OHLCV and W1 columns         (EMAs, Wilder, ATR, KAMA, sums)
    W2  rolling / lag over S1 columns                 (halo 40)
    S2  recurrences over S1/W2 columns                (MACD signal, ADX, mass-index EMA)
    W3  rolling over S2 columns                       (halo 30)

``features(bars, columns)`` builds only what ``columns`` needs: window expressions that
are not referenced are pruned by Catalyst; scans are chosen from a dependency table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..operators import scan as S
from ..operators.series import RN, Layout, index_rows, numbered, windowed

def C() -> Column:
    return F.col("close")


def H() -> Column:
    return F.col("high")


def L() -> Column:
    return F.col("low")


def O() -> Column:  # noqa: E743
    return F.col("open")


def V() -> Column:
    return F.col("volume")


def TP() -> Column:
    return (H() + L() + C()) / 3.0



def _roll(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec) -> Column:
    """Full-window rolling aggregate: NULL until the frame holds n non-null values."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(f) == n, agg(x).over(f))


def roll_avg(x, n, w):
    return _roll(F.avg, x, n, w)


def roll_sum(x, n, w):
    return _roll(F.sum, x, n, w)


def roll_max(x, n, w):
    return _roll(F.max, x, n, w)


def roll_min(x, n, w):
    return _roll(F.min, x, n, w)


def roll_std(x, n, w):
    return _roll(F.stddev_samp, x, n, w)


def roll_std_pop(x, n, w):
    return _roll(F.stddev_pop, x, n, w)


def roll_mad(x: Column, n: int, w: WindowSpec, mean: Column) -> Column:
    """Mean absolute deviation around the window mean (CCI), NULL until the frame holds n
    non-null values, as ``mean``, the row's rolling mean from an earlier level, is. Built
    from n offset (lag) windows, each O(1) per row."""
    dev = F.abs(x - mean)
    for k in range(1, n):
        dev = dev + F.abs(F.lag(x, k).over(w) - mean)
    return dev / F.lit(float(n))  # a missing value, or the mean's NULL, makes it NULL


def lag(x: Column, k: int, w: WindowSpec) -> Column:
    return F.lag(x, k).over(w)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def ratio_or_100(num: Column, den: Column) -> Column:
    """100 - 100/(1 + num/den); den = 0 with num > 0 gives 100, both 0 gives NULL."""
    return F.when((den == 0) & (num > 0), F.lit(100.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + div(num, den))
    )



# ---------------------------------------------------------------------------
# Built expressions are unbound Column trees: build each stage once per (Spark context,
# layout) and reuse it; building them costs thousands of JVM round trips.

_BUILT: dict[tuple, object] = {}


def _ctx_key() -> int:
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    return id(sc._jsc) if sc is not None else 0


def built_levels(stage: Callable[[], list], layout: Layout) -> list[list[tuple[str, Column]]]:
    key = (stage.__name__, layout, _ctx_key())
    if key not in _BUILT:
        w = layout.window()
        _BUILT[key] = [[(n, fn(w)) for n, fn in lvl] for lvl in stage()]
    return _BUILT[key]  # type: ignore[return-value]


def built_derived() -> dict[str, Column]:
    key = ("derived", _ctx_key())
    if key not in _BUILT:
        _BUILT[key] = {k: fn() for k, fn in derived_builders().items()}
    return _BUILT[key]  # type: ignore[return-value]


# ---------------------------------------------------------------------------
# W1: rolling and lag over OHLCV


def w1_levels() -> list[list[tuple[str, Callable[[WindowSpec], Column]]]]:
    lv0 = [
        ("prev_close", lambda w: lag(C(), 1, w)),
        ("prev_high", lambda w: lag(H(), 1, w)),
        ("prev_low", lambda w: lag(L(), 1, w)),
        ("prev_volume", lambda w: lag(V(), 1, w)),
        ("close_lag3", lambda w: lag(C(), 3, w)),
        ("close_lag4", lambda w: lag(C(), 4, w)),
        ("close_lag5", lambda w: lag(C(), 5, w)),
        ("close_lag10", lambda w: lag(C(), 10, w)),
        ("close_lag11", lambda w: lag(C(), 11, w)),
        ("close_lag12", lambda w: lag(C(), 12, w)),
        ("prev_open", lambda w: lag(O(), 1, w)),
        ("open_lag2", lambda w: lag(O(), 2, w)),
        ("close_lag2", lambda w: lag(C(), 2, w)),
        ("high_lag2", lambda w: lag(H(), 2, w)),
        ("low_lag2", lambda w: lag(L(), 2, w)),
        ("sma_5", lambda w: roll_avg(C(), 5, w)),
        ("sma_10", lambda w: roll_avg(C(), 10, w)),
        ("sma_20", lambda w: roll_avg(C(), 20, w)),
        ("sma_50", lambda w: roll_avg(C(), 50, w)),
        ("std_pop_20", lambda w: _roll(F.stddev_pop, C(), 20, w)),
        ("volume_sma", lambda w: roll_avg(V(), 20, w)),
        ("volume_std", lambda w: _roll(F.stddev_samp, V(), 20, w)),
        ("volume_sma_5", lambda w: roll_avg(V(), 5, w)),
        ("volume_sma_10", lambda w: roll_avg(V(), 10, w)),
        ("max_high_9", lambda w: roll_max(H(), 9, w)),
        ("min_low_9", lambda w: roll_min(L(), 9, w)),
        ("high_avg_10", lambda w: roll_avg(H(), 10, w)),
        ("low_avg_10", lambda w: roll_avg(L(), 10, w)),
        ("max_high_14", lambda w: roll_max(H(), 14, w)),
        ("min_low_14", lambda w: roll_min(L(), 14, w)),
        ("max_high_20", lambda w: roll_max(H(), 20, w)),
        ("min_low_20", lambda w: roll_min(L(), 20, w)),
        ("max_high_26", lambda w: roll_max(H(), 26, w)),
        ("min_low_26", lambda w: roll_min(L(), 26, w)),
        ("ao", lambda w: roll_avg((H() + L()) / 2.0, 5, w) - roll_avg((H() + L()) / 2.0, 34, w)),
        ("tp_avg_20", lambda w: roll_avg(TP(), 20, w)),
        ("keltner_upper", lambda w: roll_avg((4.0 * H() - 2.0 * L() + C()) / 3.0, 20, w)),
        ("keltner_lower", lambda w: roll_avg((-2.0 * H() + 4.0 * L() + C()) / 3.0, 20, w)),
        ("vwap_rolling", lambda w: div(roll_sum(TP() * V(), 14, w), roll_sum(V(), 14, w))),
        (
            "cmf",
            lambda w: div(roll_sum(div((C() - L()) - (H() - C()), H() - L()) * V(), 20, w), roll_sum(V(), 20, w)),
        ),
        ("aroon_hi_rn", lambda w: _roll_arg(H(), 25, w, first_max=True)),
        ("aroon_lo_rn", lambda w: _roll_arg(L(), 25, w, first_max=False)),
    ]
    lv1 = [
        # 50/52-bar extremes from two overlapping 26-bar extremes (max/min are idempotent)
        ("max_high_50", lambda w: F.when(F.col(RN) >= 49, F.greatest(F.col("max_high_26"), lag(F.col("max_high_26"), 24, w)))),
        ("min_low_50", lambda w: F.when(F.col(RN) >= 49, F.least(F.col("min_low_26"), lag(F.col("min_low_26"), 24, w)))),
        ("max_high_52", lambda w: F.when(F.col(RN) >= 51, F.greatest(F.col("max_high_26"), lag(F.col("max_high_26"), 26, w)))),
        ("min_low_52", lambda w: F.when(F.col(RN) >= 51, F.least(F.col("min_low_26"), lag(F.col("min_low_26"), 26, w)))),
        ("tr", lambda w: F.greatest(H() - L(), F.abs(H() - F.col("prev_close")), F.abs(L() - F.col("prev_close")))),
        ("delta_close", lambda w: C() - F.col("prev_close")),
        ("returns", lambda w: div(C(), F.col("prev_close")) - 1.0),
        ("volume_change", lambda w: div(V(), F.col("prev_volume")) - 1.0),
        ("bp_uo", lambda w: C() - F.least(L(), F.col("prev_close"))),
        ("tr_uo", lambda w: F.greatest(H(), F.col("prev_close")) - F.least(L(), F.col("prev_close"))),
        ("up_move", lambda w: H() - F.col("prev_high")),
        ("down_move", lambda w: F.col("prev_low") - L()),
        ("tp_dir", lambda w: F.signum(TP() - lag(TP(), 1, w))),
        ("vm_pos", lambda w: F.abs(H() - F.col("prev_low"))),
        ("vm_neg", lambda w: F.abs(L() - F.col("prev_high"))),
        ("tp_mad_20", lambda w: roll_mad(TP(), 20, w, F.col("tp_avg_20"))),
        ("stoch_k", lambda w: F.lit(100.0) * div(C() - F.col("min_low_14"), F.col("max_high_14") - F.col("min_low_14"))),
        # swing high / low of the previous bar, confirmed on this bar
        ("swing_high", lambda w: F.when((F.col("prev_high") > F.col("high_lag2")) & (F.col("prev_high") >= H()), F.col("prev_high"))),
        ("swing_low", lambda w: F.when((F.col("prev_low") < F.col("low_lag2")) & (F.col("prev_low") <= L()), F.col("prev_low"))),
    ]
    lv2 = [
        ("gain", lambda w: F.when(F.col("delta_close") > 0, F.col("delta_close")).otherwise(F.lit(0.0))),
        ("loss", lambda w: F.when(F.col("delta_close") < 0, -F.col("delta_close")).otherwise(F.lit(0.0))),
        ("abs_delta", lambda w: F.abs(F.col("delta_close"))),
        (
            "pos_dm",
            lambda w: F.when(
                (F.col("up_move") > F.col("down_move")) & (F.col("up_move") > 0), F.col("up_move")
            ).otherwise(F.lit(0.0)),
        ),
        (
            "neg_dm",
            lambda w: F.when(
                (F.col("down_move") > F.col("up_move")) & (F.col("down_move") > 0), F.col("down_move")
            ).otherwise(F.lit(0.0)),
        ),
        ("tr_avg_14", lambda w: roll_avg(F.col("tr"), 14, w)),
        ("vortex_pos", lambda w: div(roll_sum(F.col("vm_pos"), 14, w), roll_sum(F.col("tr"), 14, w))),
        ("vortex_neg", lambda w: div(roll_sum(F.col("vm_neg"), 14, w), roll_sum(F.col("tr"), 14, w))),
        ("volatility", lambda w: roll_std(F.col("returns"), 20, w)),
        ("prev_returns", lambda w: lag(F.col("returns"), 1, w)),
        ("prev_delta_close", lambda w: lag(F.col("delta_close"), 1, w)),
        (
            "ultimate_osc",
            lambda w: F.lit(100.0)
            * (
                4.0 * div(roll_sum(F.col("bp_uo"), 7, w), roll_sum(F.col("tr_uo"), 7, w))
                + 2.0 * div(roll_sum(F.col("bp_uo"), 14, w), roll_sum(F.col("tr_uo"), 14, w))
                + div(roll_sum(F.col("bp_uo"), 28, w), roll_sum(F.col("tr_uo"), 28, w))
            )
            / 7.0,
        ),
        ("mf_pos", lambda w: roll_sum(F.when(F.col("tp_dir") > 0, TP() * V()).otherwise(F.lit(0.0)), 14, w)),
        ("stoch_d", lambda w: roll_avg(F.col("stoch_k"), 3, w)),
        ("prev_swing_high", lambda w: F.last("swing_high", ignorenulls=True).over(w.rowsBetween(-SWING_LOOKBACK, -1))),
        ("prev_swing_low", lambda w: F.last("swing_low", ignorenulls=True).over(w.rowsBetween(-SWING_LOOKBACK, -1))),
        ("mf_neg", lambda w: roll_sum(F.when(F.col("tp_dir") < 0, TP() * V()).otherwise(F.lit(0.0)), 14, w)),
    ]
    lv3 = [
        ("rsi_gain_14", lambda w: roll_avg(F.col("gain"), 14, w)),
        ("rsi_loss_14", lambda w: roll_avg(F.col("loss"), 14, w)),
        ("dmi_pos_avg", lambda w: roll_avg(F.col("pos_dm"), 14, w)),
        ("dmi_neg_avg", lambda w: roll_avg(F.col("neg_dm"), 14, w)),
        ("atr_simple", lambda w: roll_avg(F.col("tr"), 14, w)),
        ("abs_delta_sum_10", lambda w: roll_sum(F.col("abs_delta"), 10, w)),
    ]
    return [lv0, lv1, lv2, lv3]


def _roll_arg(x: Column, n: int, w: WindowSpec, first_max: bool) -> Column:
    """Row number of the first max (or first min) inside the last n rows."""
    f = w.rowsBetween(-(n - 1), 0)
    rn = F.col(RN)
    if first_max:
        # max over (x, -rn): highest x, earliest row among ties
        pick = F.max(F.struct(x.alias("v"), (-rn).alias("r"))).over(f)
        val = -pick["r"]
    else:
        pick = F.min(F.struct(x.alias("v"), rn.alias("r"))).over(f)
        val = pick["r"]
    return F.when(F.count(x).over(f) == n, val)


W1_HALO = 120
SWING_LOOKBACK = 20  # bars searched back for the first top/bottom of a double pattern
SWING_TOLERANCE = 0.005  # relative distance of two tops (bottoms) to count as equal  # longest chain in W1 + the W2 rolling of atr_simple (100) reads W1 output

# ---------------------------------------------------------------------------
# S1 / S2: recurrences


def _s1() -> dict[str, Callable[[], S.Recurrence]]:
    d: dict[str, Callable[[], S.Recurrence]] = {}
    for n in (5, 9, 10, 12, 13, 18, 20, 26, 50, 200):
        d[f"ema_{n}"] = (lambda n=n: S.ema_span(f"ema_{n}", C(), n))
    d["volume_ema"] = lambda: S.ema_span("volume_ema", V(), 20, warmup=False)
    d["volume_ema_12"] = lambda: S.ema_span("volume_ema_12", V(), 12, warmup=False)
    d["volume_ema_26"] = lambda: S.ema_span("volume_ema_26", V(), 26, warmup=False)
    d["rsi_up"] = lambda: S.wilder("rsi_up", F.col("gain"), 14)
    d["rsi_down"] = lambda: S.wilder("rsi_down", F.col("loss"), 14)
    d["atr"] = lambda: S.seeded_rma("atr", F.col("tr"), 14, F.col("tr_avg_14"))
    d["tr_w"] = lambda: S.wilder("tr_w", F.col("tr"), 14)
    d["pos_dm_w"] = lambda: S.wilder("pos_dm_w", F.col("pos_dm"), 14)
    d["neg_dm_w"] = lambda: S.wilder("neg_dm_w", F.col("neg_dm"), 14)
    d["force_index"] = lambda: S.ema_span("force_index", F.col("delta_close") * V(), 13, start=1)
    d["kama"] = lambda: S.adaptive("kama", C(), F.col("kama_sc"), seed_row=9)
    d["ema_hl_9"] = lambda: S.ema_span("ema_hl_9", H() - L(), 9)
    d["vpt"] = lambda: S.running_sum("vpt", V() * F.col("delta_close"))
    d["obv"] = lambda: S.running_sum("obv", F.when(C() < F.col("prev_close"), -V()).otherwise(V()))
    d["cum_tpv"] = lambda: S.running_sum("cum_tpv", TP() * V())
    d["cum_v"] = lambda: S.running_sum("cum_v", V())
    return d


def _s2() -> dict[str, Callable[[], S.Recurrence]]:
    return {
        "macd_signal": lambda: S.ema_span("macd_signal", F.col("macd"), 9, start=25),
        "adx": lambda: S.wilder("adx", F.col("dx"), 14, start=13),
        "ema_hl_9_9": lambda: S.ema_span("ema_hl_9_9", F.col("ema_hl_9"), 9, start=8),
    }


S1 = _s1()
S2 = _s2()

# KAMA smoothing constant needs W1 columns; defined as a pre-S1 projection.
_FAST, _SLOW = 2.0 / (2 + 1), 2.0 / (30 + 1)


def _kama_sc() -> Column:
    er = F.when(F.col("abs_delta_sum_10") == 0, F.lit(0.0)).otherwise(
        F.abs(C() - F.col("close_lag10")) / F.col("abs_delta_sum_10")
    )
    return F.pow(er * (_FAST - _SLOW) + _SLOW, 2.0)


# ---------------------------------------------------------------------------
# W2 / W3


def w2_levels():
    rsi = ratio_or_100(F.col("rsi_up"), F.col("rsi_down"))
    return [
        [
            ("rsi", lambda w: F.when(F.col("rsi_down") == 0, F.lit(100.0)).otherwise(rsi)),
            ("macd", lambda w: F.col("ema_12") - F.col("ema_26")),
            ("ppo", lambda w: F.lit(100.0) * div(F.col("ema_12") - F.col("ema_26"), F.col("ema_26"))),
            (
                "pvo",
                lambda w: div(F.col("volume_ema_12") - F.col("volume_ema_26"), F.col("volume_ema_26")) * 100.0,
            ),
            ("plus_di", lambda w: F.lit(100.0) * div(F.col("pos_dm_w"), F.col("tr_w"))),
            ("minus_di", lambda w: F.lit(100.0) * div(F.col("neg_dm_w"), F.col("tr_w"))),
            ("atr_avg_20", lambda w: roll_avg(F.col("atr"), 20, w)),
            ("prev_trix", lambda w: lag(F.col("ema_18"), 1, w)),
            ("prev_obv", lambda w: lag(F.col("obv"), 1, w)),
            ("prev_vpt", lambda w: lag(F.col("vpt"), 1, w)),
            ("prev_ema_5", lambda w: lag(F.col("ema_5"), 1, w)),
            ("prev_ema_20", lambda w: lag(F.col("ema_20"), 1, w)),
            ("vwap", lambda w: div(F.col("cum_tpv"), F.col("cum_v"))),
            ("atr_pct_simple", lambda w: div(F.col("atr_simple"), C()) * 100.0),
        ],
        [
            ("rsi_min_14", lambda w: roll_min(F.col("rsi"), 14, w)),
            ("rsi_max_14", lambda w: roll_max(F.col("rsi"), 14, w)),
            (
                "dx",
                lambda w: F.lit(100.0)
                * div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")),
            ),
            ("atr_min_100", lambda w: roll_min(F.col("atr_simple"), 100, w)),
            ("atr_max_100", lambda w: roll_max(F.col("atr_simple"), 100, w)),
        ],
    ]


W2_HALO = 110


def w3_levels():
    return [
        [
            ("mass_index", lambda w: roll_sum(div(F.col("ema_hl_9"), F.col("ema_hl_9_9")), 25, w)),
        ]
    ]


W3_HALO = 30

# Which scan outputs each user-facing column needs (W columns are pruned by Catalyst).
NEEDS: dict[str, set[str]] = {
    "rsi": {"rsi_up", "rsi_down"},
    "rsi_wilder": {"rsi_up", "rsi_down"},
    "stoch_rsi": {"rsi_up", "rsi_down"},
    "macd": {"ema_12", "ema_26"},
    "ppo": {"ema_12", "ema_26"},
    "macd_signal": {"ema_12", "ema_26", "macd_signal"},
    "macd_hist": {"ema_12", "ema_26", "macd_signal"},
    "pvo": {"volume_ema_12", "volume_ema_26"},
    "plus_di": {"tr_w", "pos_dm_w", "neg_dm_w"},
    "minus_di": {"tr_w", "pos_dm_w", "neg_dm_w"},
    "dx": {"tr_w", "pos_dm_w", "neg_dm_w"},
    "adx": {"tr_w", "pos_dm_w", "neg_dm_w", "adx"},
    "atr": {"atr"},
    "atr_avg_20": {"atr"},
    "trix": {"ema_18"},
    "prev_trix": {"ema_18"},
    "obv": {"obv"},
    "prev_obv": {"obv"},
    "vpt": {"vpt"},
    "prev_vpt": {"vpt"},
    "vwap": {"cum_tpv", "cum_v"},
    "vwap_cum": {"cum_tpv", "cum_v"},
    "mass_index": {"ema_hl_9", "ema_hl_9_9"},
    "kama": {"kama"},
    "force_index": {"force_index"},
    "volume_ema": {"volume_ema"},
    "prev_ema_5": {"ema_5"},
    "prev_ema_20": {"ema_20"},
}
for _n in (5, 9, 10, 12, 13, 18, 20, 26, 50, 200):
    NEEDS[f"ema_{_n}"] = {f"ema_{_n}"}


def needed_scans(columns: Iterable[str]) -> tuple[list[str], list[str]]:
    need: set[str] = set()
    for c in columns:
        need |= NEEDS.get(c, set())
    return [k for k in S1 if k in need], [k for k in S2 if k in need]


# ---------------------------------------------------------------------------
# Derived, row-local columns (after all stages)


def derived_builders() -> dict[str, Callable[[], Column]]:
    return {
        "trix": lambda: F.col("ema_18"),
        "rsi_wilder": lambda: F.col("rsi"),
        "rsi_simple": lambda: ratio_or_100(F.col("rsi_gain_14"), F.col("rsi_loss_14")),
        "macd_hist": lambda: F.col("macd") - F.col("macd_signal"),
        "bb_mid": lambda: F.col("sma_20"),
        "bb_upper": lambda: F.col("sma_20") + 2.0 * F.col("std_pop_20"),
        "bb_lower": lambda: F.col("sma_20") - 2.0 * F.col("std_pop_20"),
        "bb_width": lambda: div(4.0 * F.col("std_pop_20"), F.col("sma_20")),
        "bb_width_close": lambda: div(4.0 * F.col("std_pop_20"), C()),
        "bb_pct": lambda: div(C() - (F.col("sma_20") - 2.0 * F.col("std_pop_20")), 4.0 * F.col("std_pop_20")),
        "volume_ratio": lambda: div(V(), F.col("volume_sma")),
        "volume_intensity": lambda: div(V(), F.col("volume_sma_10")),
        "true_range": lambda: F.col("tr"),
        "dmi_plus": lambda: F.lit(100.0) * div(F.col("dmi_pos_avg"), F.col("atr_simple")),
        "dmi_minus": lambda: F.lit(100.0) * div(F.col("dmi_neg_avg"), F.col("atr_simple")),
        "cci": lambda: div(TP() - F.col("tp_avg_20"), 0.015 * F.col("tp_mad_20")),
        "dpo": lambda: F.col("close_lag11") - F.col("sma_20"),
        "ichimoku_a": lambda: ((F.col("max_high_9") + F.col("min_low_9")) / 2.0 + (F.col("max_high_26") + F.col("min_low_26")) / 2.0)
        / 2.0,
        "ichimoku_b": lambda: (F.col("max_high_52") + F.col("min_low_52")) / 2.0,
        "donchian_width": lambda: div(F.col("max_high_20") - F.col("min_low_20"), F.col("sma_20")) * 100.0,
        "keltner_width": lambda: F.col("keltner_upper") - F.col("keltner_lower"),
        "williams_r": lambda: F.lit(-100.0) * div(F.col("max_high_14") - C(), F.col("max_high_14") - F.col("min_low_14")),
        "stoch_rsi": lambda: div(F.col("rsi") - F.col("rsi_min_14"), F.col("rsi_max_14") - F.col("rsi_min_14")),
        "roc": lambda: div(C() - F.col("close_lag12"), F.col("close_lag12")) * 100.0,
        "ease_of_movement": lambda: div(
            ((H() - F.col("prev_high")) + (L() - F.col("prev_low"))) * (H() - L()), 2.0 * V()
        )
        * 1e8,
        "mfi": lambda: ratio_or_100(F.col("mf_pos"), F.col("mf_neg")),
        "aroon_osc": lambda: (F.col("aroon_hi_rn") - F.col("aroon_lo_rn")) * 100.0 / 25.0,
        "pivot_mean": lambda: F.col("tp_avg_20"),
        "log_returns": lambda: F.log1p(F.col("returns")),
        "price_acceleration": lambda: F.col("returns") - F.col("prev_returns"),
        "range_pct": lambda: div(H() - L(), C()),
        "hlc3": lambda: TP(),
        "ohlc4": lambda: (O() + H() + L() + C()) / 4.0,
        "high_low_ratio": lambda: div(H(), L()),
        "close_open_ratio": lambda: div(C(), O()),
        "price_position": lambda: div(C() - L(), H() - L()),
        "hl_intensity": lambda: F.abs(H() - L()) / (F.abs(C() - O()) + 0.001),
        "trend_intensity": lambda: div(F.abs(C() - O()), H() - L()),
        "vwap_cum": lambda: F.col("vwap"),
        "candle_engulfing": lambda: F.when(
            (F.col("prev_close") < F.col("prev_open")) & (C() > O()) & (O() <= F.col("prev_close")) & (C() >= F.col("prev_open")), 1
        )
        .when((F.col("prev_close") > F.col("prev_open")) & (C() < O()) & (O() >= F.col("prev_close")) & (C() <= F.col("prev_open")), -1)
        .otherwise(0),
        "candle_doji": lambda: F.when(F.abs(C() - O()) <= 0.1 * (H() - L()), 1).otherwise(0),
        "candle_morning_star": lambda: F.when(
            (F.col("close_lag2") < F.col("open_lag2"))
            & (F.abs(F.col("prev_close") - F.col("prev_open")) <= 0.3 * F.abs(F.col("close_lag2") - F.col("open_lag2")))
            & (F.greatest(F.col("prev_open"), F.col("prev_close")) < F.col("close_lag2"))
            & (C() > O())
            & (C() > (F.col("open_lag2") + F.col("close_lag2")) / 2.0),
            1,
        ).otherwise(0),
        "candle_evening_star": lambda: F.when(
            (F.col("close_lag2") > F.col("open_lag2"))
            & (F.abs(F.col("prev_close") - F.col("prev_open")) <= 0.3 * F.abs(F.col("close_lag2") - F.col("open_lag2")))
            & (F.least(F.col("prev_open"), F.col("prev_close")) > F.col("close_lag2"))
            & (C() < O())
            & (C() < (F.col("open_lag2") + F.col("close_lag2")) / 2.0),
            1,
        ).otherwise(0),
        "double_top": lambda: F.when(
            F.col("swing_high").isNotNull()
            & (F.abs(F.col("swing_high") - F.col("prev_swing_high")) <= SWING_TOLERANCE * F.col("prev_swing_high")),
            1,
        ).otherwise(0),
        "double_bottom": lambda: F.when(
            F.col("swing_low").isNotNull()
            & (F.abs(F.col("swing_low") - F.col("prev_swing_low")) <= SWING_TOLERANCE * F.col("prev_swing_low")),
            1,
        ).otherwise(0),
        "fib_pivot": lambda: (F.col("prev_high") + F.col("prev_low") + F.col("prev_close")) / 3.0,
        "fib_r1": lambda: (F.col("prev_high") + F.col("prev_low") + F.col("prev_close")) / 3.0
        + 0.382 * (F.col("prev_high") - F.col("prev_low")),
        "fib_r2": lambda: (F.col("prev_high") + F.col("prev_low") + F.col("prev_close")) / 3.0
        + 0.618 * (F.col("prev_high") - F.col("prev_low")),
        "fib_r3": lambda: (F.col("prev_high") + F.col("prev_low") + F.col("prev_close")) / 3.0 + (F.col("prev_high") - F.col("prev_low")),
        "fib_s1": lambda: (F.col("prev_high") + F.col("prev_low") + F.col("prev_close")) / 3.0
        - 0.382 * (F.col("prev_high") - F.col("prev_low")),
        "fib_s2": lambda: (F.col("prev_high") + F.col("prev_low") + F.col("prev_close")) / 3.0
        - 0.618 * (F.col("prev_high") - F.col("prev_low")),
        "fib_s3": lambda: (F.col("prev_high") + F.col("prev_low") + F.col("prev_close")) / 3.0 - (F.col("prev_high") - F.col("prev_low")),
        "support_20": lambda: F.col("min_low_20"),
        "support_50": lambda: F.col("min_low_50"),
        "resistance_20": lambda: F.col("max_high_20"),
        "resistance_50": lambda: F.col("max_high_50"),
        # ATR% now vs the 100-bar ATR range, both over the current close (which cancels)
        "volatility_norm": lambda: F.when(
            div(F.col("atr_max_100"), C()) == div(F.col("atr_min_100"), C()), F.lit(0.0)
        ).otherwise(
            F.round(
                div(
                    div(F.col("atr_simple"), C()) * 100.0 - div(F.col("atr_min_100"), C()) * 100.0,
                    div(F.col("atr_max_100"), C()) * 100.0 - div(F.col("atr_min_100"), C()) * 100.0,
                )
                * 100.0,
                2,
            )
        ),
    }




#: Derived columns that read their own bar only.
ROW_LOCAL = {"range_pct", "hlc3", "ohlc4", "high_low_ratio", "close_open_ratio", "price_position", "hl_intensity", "trend_intensity", "candle_doji"}


def features(
    bars: DataFrame,
    columns: Iterable[str] | None = None,
    layout: Layout | None = None,
    indexed: bool = False,
    materialize: bool = True,
) -> DataFrame:
    """Bars plus indicator columns. ``columns=None`` builds everything.

    The numbered bars are checkpointed once (``materialize``) into the session's
    checkpoint folder: every stage below reads them in several branches, and without the
    cut each branch would re-aggregate the ticks. The result keeps the layout columns
    (``_rn``, ``_blk``) so that later window work reuses the numbering; drop them with
    ``drop_layout``.
    """
    layout = layout or Layout()
    cols = list(columns) if columns is not None else None
    if cols is not None and not indexed and set(cols) <= ROW_LOCAL:
        # read nothing but their own bar: no numbering, no window
        return bars.withColumns({k: built_derived()[k] for k in cols})
    if indexed:
        df = bars
    elif materialize:
        df = numbered(bars, layout)
    else:
        df = index_rows(bars, layout)
    df = windowed(df, layout, W1_HALO, built_levels(w1_levels, layout))
    df = df.withColumn("kama_sc", _kama_sc())
    if cols is None:
        s1, s2 = list(S1), list(S2)
    else:
        s1, s2 = needed_scans(cols)
        if s2:
            # S2 inputs are S1 outputs
            s1 = list(dict.fromkeys(s1 + [k for k in S1 if k in {"ema_12", "ema_26", "tr_w", "pos_dm_w", "neg_dm_w", "ema_hl_9"}
                                          and _s2_needs(s2, k)]))
    df = S.linear_scan(df, layout, [S1[k]() for k in s1])
    have = set(s1)
    w2 = [[(n, c) for n, c in lvl if _w2_ok(n, have)] for lvl in built_levels(w2_levels, layout)]
    if s2 or cols is None or _reads(cols, {n for lvl in w2 for n, _ in lvl}):
        df = windowed(df, layout, W2_HALO, w2)
    df = S.linear_scan(df, layout, [S2[k]() for k in s2])
    have |= set(s2)
    if {"ema_hl_9", "ema_hl_9_9"} <= have:
        df = windowed(df, layout, W3_HALO, built_levels(w3_levels, layout))
    present = set(df.columns)
    wanted = set(cols) if cols is not None else None
    add = {k: v for k, v in built_derived().items() if _derived_ok(k, present) and (wanted is None or k in wanted)}
    return df.withColumns(add)


def _reads(cols: Iterable[str], names: set[str]) -> bool:
    """Whether a wanted column is one of ``names`` or is derived from one."""
    derived = built_derived()
    return any(c in names or c in derived and names & set(re.findall(r"\w+", str(derived[c]))) for c in cols)


_S2_INPUTS = {"macd_signal": {"ema_12", "ema_26"}, "adx": {"tr_w", "pos_dm_w", "neg_dm_w"}, "ema_hl_9_9": {"ema_hl_9"}}


def _s2_needs(s2: list[str], k: str) -> bool:
    return any(k in _S2_INPUTS[s] for s in s2)


_W2_NEEDS = {
    "rsi": {"rsi_up", "rsi_down"},
    "macd": {"ema_12", "ema_26"},
    "ppo": {"ema_12", "ema_26"},
    "pvo": {"volume_ema_12", "volume_ema_26"},
    "plus_di": {"tr_w", "pos_dm_w"},
    "minus_di": {"tr_w", "neg_dm_w"},
    "atr_avg_20": {"atr"},
    "prev_trix": {"ema_18"},
    "prev_obv": {"obv"},
    "prev_vpt": {"vpt"},
    "prev_ema_5": {"ema_5"},
    "prev_ema_20": {"ema_20"},
    "vwap": {"cum_tpv", "cum_v"},
    "rsi_min_14": {"rsi_up", "rsi_down"},
    "rsi_max_14": {"rsi_up", "rsi_down"},
    "dx": {"tr_w", "pos_dm_w", "neg_dm_w"},
}


def _w2_ok(name: str, have: set[str]) -> bool:
    return _W2_NEEDS.get(name, set()) <= have


_DERIVED_REQ = {
    "trix": {"ema_18"},
    "rsi_wilder": {"rsi"},
    "macd_hist": {"macd", "macd_signal"},
    "stoch_rsi": {"rsi", "rsi_min_14"},
    "vwap_cum": {"vwap"},
}


def _derived_ok(name: str, present: set[str]) -> bool:
    return _DERIVED_REQ.get(name, set()) <= present
