"""Linear-recurrence scan ``y[t] = a[t] * y[t-1] + c[t]`` per series, in JVM windows.

Recursive indicators (EMA, Wilder smoothing, seeded ATR, KAMA, running sums) are all
this one recurrence with different (a, c) columns; ``a = 1, c = 0`` carries the previous
value unchanged. A series starts from 0, so its first value is ``a = 1, c = x``; ``a`` is
never 0 (the smallest in use, 0.55 for KAMA, keeps 128 factors far from underflow).

1. Within a sub-block of ``SUB_ROWS`` rows the partial value is a running sum,
   ``z[t] = p[t] * sum(c / p)`` with ``p`` the running product of ``a``.
2. The sub-block ends (one row in 128) are folded for each (symbol, block), the block ends
   for each (symbol, group of ``GROUP_BLOCKS`` blocks) and the group ends for each symbol with
   ``F.aggregate``, so no task folds all blocks of a long series; this gives the value that
   enters each sub-block, and ``y = z + p * carry``.

Windows and the join of the carries keep the (symbol, block) partitioning of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import BLK, RN, Layout

SUB = "_sub"
#: Rows whose product of ``a`` stays a normal double for every recurrence here.
SUB_ROWS = 128

GROUP = "_grp"
#: Blocks folded together; a series of 10^11 rows in blocks of 4,096 has 6,000 such groups.
GROUP_BLOCKS = 4096


@dataclass(frozen=True)
class Recurrence:
    """One scanned output column: ``out = a * out[t-1] + c``, NULL where ``valid`` is false.

    ``a`` must be above 0; None stands for 1 on every row (a running sum)."""

    out: str
    a: Column | None
    c: Column
    valid: Column | None = None


_FOLD = "struct<y:double,q:double,ins:array<struct<k:double,q:double>>>"


def _fold(entries: str, z: str, p: str) -> Column:
    """Run the recurrence over an array of ends: the last value and product, and what enters each entry."""
    start = F.struct(F.lit(0.0).alias("y"), F.lit(1.0).alias("q"), F.array().alias("ins")).cast(_FOLD)

    def step(acc, e):
        return F.struct(
            (e[p] * acc["y"] + e[z]).alias("y"),
            (e[p] * acc["q"]).alias("q"),
            F.concat(acc["ins"], F.array(F.struct(acc["y"].alias("k"), acc["q"].alias("q")))).alias("ins"),
        ).cast(_FOLD)

    return F.aggregate(entries, start, step)


def linear_scan(df: DataFrame, layout: Layout, recs: Sequence[Recurrence]) -> DataFrame:
    """Add one column per recurrence. ``df`` must carry the layout columns (``_rn``, ``_blk``)."""
    if not recs:
        return df
    by = list(layout.by)
    names = [r.out for r in recs]
    one = {r.out for r in recs if r.a is None}
    rows = Window.partitionBy(*by, BLK, SUB).orderBy(RN)
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    staged = df.withColumn(SUB, F.floor(F.col(RN) / F.lit(SUB_ROWS)))
    staged = staged.withColumns({f"_p_{r.out}": F.product(F.coalesce(r.a.cast("double"), F.lit(1.0))).over(upto) for r in recs if r.a is not None})
    p = {n: F.lit(1.0) if n in one else F.col(f"_p_{n}") for n in names}
    staged = staged.withColumns({f"_z_{r.out}": p[r.out] * F.sum(F.coalesce(r.c.cast("double"), F.lit(0.0)) / p[r.out]).over(upto) for r in recs})

    ends = staged.withColumn("_last", F.lead(RN).over(rows).isNull()).filter("_last")
    ends = ends.select(*by, BLK, F.struct(SUB, *[F.col(f"_z_{n}") for n in names], *[p[n].alias(f"_p_{n}") for n in names]).alias("_e"))
    blocks = ends.groupBy(*by, BLK).agg(F.array_sort(F.collect_list("_e")).alias("_s"))
    blocks = blocks.select(*by, BLK, F.transform("_s", lambda e: e[SUB]).alias("_subs"), *[_fold("_s", f"_z_{n}", f"_p_{n}").alias(f"_f_{n}") for n in names])
    # One row for each block, read for the block carries and for the sub-block carries.
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    tails = F.struct(BLK, *[F.col(f"_f_{n}.y").alias(f"_z_{n}") for n in names], *[F.col(f"_f_{n}.q").alias(f"_p_{n}") for n in names])
    groups = blocks.groupBy(*by, F.floor(F.col(BLK) / F.lit(GROUP_BLOCKS)).alias(GROUP)).agg(F.array_sort(F.collect_list(tails)).alias("_s"))
    groups = groups.select(*by, GROUP, F.transform("_s", lambda e: e[BLK]).alias("_blks"), *[_fold("_s", f"_z_{n}", f"_p_{n}").alias(f"_g_{n}") for n in names])
    heads = F.struct(GROUP, *[F.col(f"_g_{n}.y").alias(f"_z_{n}") for n in names], *[F.col(f"_g_{n}.q").alias(f"_p_{n}") for n in names])
    series = groups.groupBy(*by).agg(F.array_sort(F.collect_list(heads)).alias("_s"))
    series = series.select(*by, F.transform("_s", lambda e: e[GROUP]).alias("_grps"), *[_fold("_s", f"_z_{n}", f"_p_{n}")["ins"].alias(f"_i_{n}") for n in names])
    series = series.select(*by, *[f"_i_{n}" for n in names], F.posexplode("_grps").alias("_at", GROUP))
    series = series.select(*by, GROUP, *[F.get(f"_i_{n}", F.col("_at"))["k"].alias(f"_h_{n}") for n in names])
    series = groups.join(series, [*by, GROUP]).select(*by, *[c for n in names for c in (f"_g_{n}", f"_h_{n}")], F.posexplode("_blks").alias("_at", BLK))

    def starts(n: str) -> Column:
        own = F.get(F.col(f"_g_{n}.ins"), F.col("_at"))
        return (own["k"] + own["q"] * F.col(f"_h_{n}")).alias(f"_b_{n}")

    series = series.select(*by, BLK, *[starts(n) for n in names])
    carry = blocks.join(series, [*by, BLK]).select(*by, BLK, *[f"_f_{n}" for n in names], *[f"_b_{n}" for n in names], F.posexplode("_subs").alias("_at", SUB))

    def enters(n: str) -> Column:
        own = F.get(F.col(f"_f_{n}.ins"), F.col("_at"))
        return (own["k"] + own["q"] * F.col(f"_b_{n}")).alias(f"_k_{n}")

    carry = carry.select(*by, BLK, SUB, *[enters(n) for n in names])
    out = staged.join(carry, [*by, BLK, SUB])
    ys = {}
    for r in recs:
        y = F.col(f"_z_{r.out}") + p[r.out] * F.col(f"_k_{r.out}")
        ys[r.out] = F.when(r.valid, y) if r.valid is not None else y
    spent = [SUB, *[f"_{c}_{n}" for c in "zk" for n in names], *[f"_p_{n}" for n in names if n not in one]]
    return out.withColumns(ys).drop(*spent)


# ---------------------------------------------------------------------------
# Recurrence builders. Indicator inputs are non-null OHLCV (the cleaning step drops or
# fills nulls first), so the row where a derived input starts is a known row number:
# ``start`` is that ``_rn``; rows before it are identity rows and NULL in the output.
# A null input after the start carries the previous value.

def _rn() -> Column:
    return F.col(RN)


def ewm(out: str, x: Column, alpha: float, start: int = 0, min_periods: int = 1) -> Recurrence:
    """Exponential mean, adjust=False: y = x at row ``start``, then (1-alpha) y + alpha x.

    Output NULL for the first ``min_periods - 1`` rows after ``start``.
    """
    a = F.when((_rn() <= start) | x.isNull(), F.lit(1.0)).otherwise(F.lit(1.0 - alpha))
    c = F.when((_rn() < start) | x.isNull(), F.lit(0.0)).when(_rn() == start, x).otherwise(F.lit(alpha) * x)
    return Recurrence(out, a, c, _rn() >= start + max(min_periods, 1) - 1)


def ema_span(out: str, x: Column, span: int, start: int = 0, warmup: bool = True) -> Recurrence:
    """EMA with alpha = 2/(span+1); NULL for the first span-1 rows when ``warmup``."""
    return ewm(out, x, 2.0 / (span + 1), start, span if warmup else 1)


def wilder(out: str, x: Column, n: int, start: int = 0) -> Recurrence:
    """Wilder smoothing (alpha = 1/n), NULL for the first n-1 rows."""
    return ewm(out, x, 1.0 / n, start, n)


def seeded_rma(out: str, x: Column, n: int, seed: Column, start: int = 0) -> Recurrence:
    """Wilder average seeded with the mean of the first n inputs (ATR form):
    y = seed at row start+n-1, then ((n-1) y + x) / n."""
    s = start + n - 1
    a = F.when(_rn() <= s, F.lit(1.0)).otherwise(F.lit((n - 1) / n))
    c = F.when(_rn() < s, F.lit(0.0)).when(_rn() == s, seed).otherwise(x / F.lit(float(n)))
    return Recurrence(out, a, c, _rn() >= s)


def adaptive(out: str, x: Column, sc: Column, seed_row: int) -> Recurrence:
    """y = x at ``seed_row``, then y + sc (x - y) — KAMA form."""
    a = F.when(_rn() <= seed_row, F.lit(1.0)).otherwise(F.lit(1.0) - sc)
    c = F.when(_rn() < seed_row, F.lit(0.0)).when(_rn() == seed_row, x).otherwise(sc * x)
    return Recurrence(out, a, c, _rn() >= seed_row)


def running_sum(out: str, x: Column) -> Recurrence:
    """Cumulative sum; null inputs add nothing and their own row stays NULL."""
    return Recurrence(out, None, F.coalesce(x, F.lit(0.0)), x.isNotNull())
