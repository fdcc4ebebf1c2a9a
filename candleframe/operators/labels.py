"""Leak-free labels, chronological splits and scalers.

Forward labels use ``lead`` over the blocked layout with a forward halo. Splits compare
the series row number with the series count (no whole-series window). Scalers fit per
series on train rows only and are applied by a join with the small statistics table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import series_counts
from .joins import join_small
from .series import RN, Layout, windowed


def forward_labels(f: DataFrame, layout: Layout | None = None, reference_mode: bool = False) -> DataFrame:
    """Adds label_up_1 / label_up_3 / label_up_10 (close k bars ahead > close, 0/1),
    label_3way (3-bar forward return > 0.1% -> 1, < -0.1% -> -1, else 0) and next_return.

    Rows without the future bar are NULL (drop them before fitting); ``reference_mode``
    gives 0 there instead, as the reference does (that label is a forced 0)."""
    layout = layout or Layout()
    c = F.col("close")
    steps = [
        [
            ("_lead_1", lambda w: F.lead("close", 1).over(w)),
            ("_lead_3", lambda w: F.lead("close", 3).over(w)),
            ("_lead_10", lambda w: F.lead("close", 10).over(w)),
            ("_next_ret", lambda w: F.lead("returns", 1).over(w)),
        ]
    ]
    d = windowed(f, layout, 0, steps, ahead=10)

    def up(k: int) -> Column:
        x = (F.col(f"_lead_{k}") > c).cast("int")
        return F.coalesce(x, F.lit(0)) if reference_mode else x

    fwd3 = F.try_divide(F.col("_lead_3"), c) - 1.0
    three = F.when(fwd3 > 0.001, 1).when(fwd3 < -0.001, -1).when(fwd3.isNotNull(), 0)
    if reference_mode:
        three = F.coalesce(three, F.lit(0))
    return d.withColumns(
        {
            "label_up_1": up(1),
            "label_up_3": up(3),
            "label_up_10": up(10),
            "label_3way": three.cast("int"),
            "next_return": F.col("_next_ret"),
        }
    ).drop("_lead_1", "_lead_3", "_lead_10", "_next_ret")


def split_chrono(f: DataFrame, test_fraction: float = 0.2, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """``is_test``: the last ceil(test_fraction * n) rows of each series."""
    j = join_small(f, series_counts(f, by), list(by), "inner")
    cut = F.floor(F.col("_n") * (1.0 - test_fraction))
    return j.withColumn("is_test", F.col(RN) >= cut).drop("_n")


def split_time_series(f: DataFrame, max_test: int = 20, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last fold of a time-series split: test = last min(max_test, n // 5) rows."""
    j = join_small(f, series_counts(f, by), list(by), "inner")
    k = F.least(F.lit(max_test), F.floor(F.col("_n") / 5))
    return j.withColumn("is_test", F.col(RN) >= F.col("_n") - k).drop("_n")


def filled_next_return() -> Column:
    """``next_return`` with the last row of a series given the label of the row before it, which is its own return."""
    return F.coalesce(F.col("next_return"), F.col("returns"))


def split_random(f: DataFrame, key: Sequence[Column], test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Shuffled split by a hash of each row's key (leaks the future into training; not the default).

    A row's side depends on its key and the seed alone, so tasks that run again give the same split."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return f.withColumn("is_test", place < int(test_fraction * (1 << 32)))


def scale_standard(f: DataFrame, cols: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """z-score with the train rows' mean and population std, per series."""
    stats = (
        f.filter(~F.col("is_test"))
        .groupBy(*by)
        .agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    )
    j = join_small(f, stats, list(by), "inner")
    return j.withColumns(
        {f"{c}_z": F.try_divide(F.col(c) - F.col(f"_mu_{c}"), F.col(f"_sd_{c}")) for c in cols}
    ).drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def scale_robust(f: DataFrame, cols: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(x - median) / (q75 - q25) with exact train-row percentiles, per series (band-based,
    no whole-group buffer)."""
    from .quantiles import exact_percentiles

    train = f.filter(~F.col("is_test"))
    stats = None
    for c in cols:
        q = exact_percentiles(train, by, c, [0.25, 0.5, 0.75])
        q = q.groupBy(*by).agg(
            F.array(*[F.max(F.when(F.col("p") == p, F.col("percentile"))) for p in (0.25, 0.5, 0.75)]).alias(f"_q_{c}")
        )
        stats = q if stats is None else stats.join(q, list(by), "full_outer")
    j = join_small(f, stats, list(by), "inner")
    return j.withColumns(
        {
            f"{c}_r": F.try_divide(F.col(c) - F.col(f"_q_{c}")[1], F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0])
            for c in cols
        }
    ).drop(*[f"_q_{c}" for c in cols])
