"""Validation, cleaning and per-series row selection.

Per-series facts (row count, max epoch) are group aggregates (map-side combined, so a hot
symbol is pre-reduced) joined back through ``join_small``; nothing here runs a window over
a whole symbol. Fills use the blocked series layout with a per-block carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_small
from .series import BLK, RN, Layout, index_rows, numbered

OHLCV = ("open", "high", "low", "close", "volume")


class MissingColumnsError(ValueError):
    pass


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"Missing required columns: {', '.join(missing)}")
    return df


def coerce_numeric(df: DataFrame, cols: Sequence[str] = OHLCV) -> DataFrame:
    """String (or any) -> DOUBLE; unparsable text, NaN and +-inf become NULL."""
    out = {}
    for c in cols:
        x = F.expr(f"try_cast(trim(cast(`{c}` AS STRING)) AS DOUBLE)")
        out[c] = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)
    return df.withColumns(out)


def replace_inf(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(F.col(c)) == float("inf"), None).otherwise(F.col(c)) for c in cols})


def null_report(df: DataFrame, cols: Sequence[str] = OHLCV, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per series: rows and NULL count per required column (the reject test as data)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
    )


def reject_non_numeric(df: DataFrame, cols: Sequence[str] = OHLCV, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows of series that have no NULL in ``cols`` (series with any are rejected whole)."""
    bad = df.groupBy(*by).agg(F.count_if(F.greatest(*[F.col(c).isNull() for c in cols])).alias("_bad"))
    ok = bad.filter(F.col("_bad") == 0).select(*by)
    return join_small(df, ok, list(by), "left_semi")


def drop_null_rows(df: DataFrame, cols: Sequence[str] = OHLCV) -> DataFrame:
    return df.na.drop(subset=list(cols))


def series_counts(df: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))


def min_rows_gate(df: DataFrame, min_rows: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Keep only series with at least ``min_rows`` rows."""
    ok = series_counts(df, by).filter(F.col("_n") >= min_rows).select(*by)
    return join_small(df, ok, list(by), "left_semi")


def epoch_ms_to_s(df: DataFrame, col: str = "timestamp", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Divide a series' epoch column by 1000 when the series' max exceeds 1e10 (ms)."""
    mx = df.groupBy(*by).agg(F.max(col).alias("_max_epoch"))
    j = join_small(df, mx, list(by), "left")
    return j.withColumn(
        col, F.when(F.col("_max_epoch") > 1e10, F.col(col).cast("double") / 1000.0).otherwise(F.col(col).cast("double"))
    ).drop("_max_epoch")


def epoch_to_datetime(df: DataFrame, col: str = "timestamp", out: str = "ts") -> DataFrame:
    """Seconds since epoch (fractions kept to microseconds) -> TIMESTAMP_NTZ (UTC wall time)."""
    micros = F.round(F.col(col) * 1_000_000).cast("long")
    return df.withColumn(out, F.to_timestamp_ntz(F.timestamp_micros(micros).cast("string")))


def select_ohlcv(df: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    return df.select(*keys, *OHLCV)


def latest_row(df: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Last row per series as a group aggregate (partial aggregation; no window)."""
    others = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*[F.col(c) for c in others]), F.col(ts)).alias("_r")).select(
        *by, "_r.*"
    )


def _with_counts(df: DataFrame, layout: Layout) -> DataFrame:
    indexed = df if RN in df.columns else numbered(df, layout)
    return join_small(indexed, series_counts(indexed, layout.by), list(layout.by), "inner")


def tail_n(df: DataFrame, n: int, layout: Layout | None = None) -> DataFrame:
    """Last n rows of each series. Spark keeps n rows of a series in each map task
    (WindowGroupLimit) before it shuffles, so a long series needs no numbering."""
    layout = layout or Layout()
    w = Window.partitionBy(*layout.by).orderBy(F.desc(layout.ts))
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def drop_last_n(df: DataFrame, n: int, layout: Layout | None = None) -> DataFrame:
    layout = layout or Layout()
    j = _with_counts(df, layout)
    return j.filter(F.col(RN) < F.col("_n") - n).drop("_n")


def ffill(df: DataFrame, cols: Sequence[str], layout: Layout | None = None, backfill: bool = False) -> DataFrame:
    """Forward fill (then optionally back fill) per series, exact across row blocks.

    Inside a block ``last(x, ignorenulls)`` over the running frame; rows still NULL take
    the last non-null value of earlier blocks from a one-row-per-block carry table.
    ``backfill`` fills leading NULLs from the future (leaks; off by default).
    """
    layout = layout or Layout()
    by = list(layout.by)
    d = df if RN in df.columns else numbered(df, layout)
    w = Window.partitionBy(*by, BLK).orderBy(RN)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_ff_{c}": F.last(F.col(c), ignorenulls=True).over(run) for c in cols})
    ends = d.groupBy(*by, BLK).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(RN))).alias(f"_e_{c}") for c in cols]
    )
    prev = Window.partitionBy(*by).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, BLK, *[F.last(F.col(f"_e_{c}"), ignorenulls=True).over(prev).alias(f"_k_{c}") for c in cols])
    d = join_small(d, carry, [*by, BLK], "left")
    d = d.withColumns({c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_k_{c}")) for c in cols}).drop(
        *[f"_ff_{c}" for c in cols], *[f"_k_{c}" for c in cols]
    )
    if backfill:
        firsts = d.groupBy(*by).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(RN))).alias(f"_f_{c}") for c in cols])
        d = join_small(d, firsts, by, "left")
        d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in cols}).drop(*[f"_f_{c}" for c in cols])
    return d


def is_in(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return join_small(df, keys, on, "left_semi")


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)
