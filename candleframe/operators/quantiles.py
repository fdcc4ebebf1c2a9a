"""Exact group percentiles without gathering a group's values in one buffer.

``percentile`` / ``median`` keep every distinct value of a group in one aggregation
buffer, which a symbol holding a third of the rows cannot afford. Here:

1. per group: row count n and ``percentile_approx`` at p -/+ margin (a mergeable,
   bounded-memory sketch whose rank error is at most n / accuracy);
2. per group: rows below the lower bound are only counted; values inside the band are
   reduced to (value, count) pairs, at most ~4 n / accuracy distinct values;
3. a running count over the band (ordered by value, partitioned by group and p) finds
   the values at ranks floor(h) and floor(h)+1, h = (n-1) p, and interpolates linearly
   (the definition of Spark's ``percentile`` and DuckDB's ``quantile_cont``).

The band is guaranteed to hold both ranks, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_small

ACCURACY = 10_000


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """One row per (by..., p): ``p`` and ``percentile``. NULL values are ignored."""
    by = list(by)
    # two passes read the values: keep them (recomputed from lineage if an executor is lost)
    v = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    margin = 3.0 / accuracy
    lo_p = [max(0.0, p - margin) for p in probs]
    hi_p = [min(1.0, p + margin) for p in probs]
    sk = v.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", lo_p, accuracy).alias("_lo"),
        F.percentile_approx("_v", hi_p, accuracy).alias("_hi"),
    )
    # one row per (group, p) with its band
    k = len(probs)
    pa = F.array(*[F.lit(float(p)) for p in probs])
    j = join_small(v, sk, by, "inner")  # one sketch row per group
    below = (
        j.groupBy(*by)
        .agg(
            F.first("_n").alias("_n"),
            F.array(*[F.count_if(F.col("_v") < F.col("_lo")[i]) for i in range(k)]).alias("_b"),
            # first value after each band: the upper neighbour when the band ends at rank k0
            F.array(*[F.min(F.when(F.col("_v") > F.col("_hi")[i], F.col("_v"))) for i in range(k)]).alias("_a"),
            # last value before each band: rank k0 when the band starts at k0 + 1
            F.array(*[F.max(F.when(F.col("_v") < F.col("_lo")[i], F.col("_v"))) for i in range(k)]).alias("_z"),
        )
        .select(*by, "_n", "_a", "_z", F.posexplode("_b").alias("_i", "_below"))
        .withColumn("p", pa[F.col("_i")])
        .withColumn("_after", F.col("_a")[F.col("_i")])
        .withColumn("_before", F.col("_z")[F.col("_i")])
        .drop("_a", "_z")
    )
    # only values inside a band go on; a value sitting in several bands is emitted per band
    inside = F.filter(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("_v") >= F.col("_lo")[i]) & (F.col("_v") <= F.col("_hi")[i])
    )
    band = (
        j.select(*by, "_v", F.explode(inside).alias("_i"))
        .groupBy(*by, "_i", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("p", pa[F.col("_i")])
    )
    w = Window.partitionBy(*by, "p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = band.withColumn("_cum", F.sum("_c").over(w))
    ranked = join_small(ranked, below.drop("_i"), [*by, "p"], "inner")
    h = (F.col("_n") - 1).cast("double") * F.col("p")
    k0 = F.floor(h)
    # ranks covered by a (value, count) row: [below + cum - c, below + cum - 1]
    start = F.col("_below") + F.col("_cum") - F.col("_c")
    end = F.col("_below") + F.col("_cum") - 1
    picks = ranked.withColumn("_h", h).withColumn("_k0", k0).select(
        *by,
        "p",
        "_h",
        "_k0",
        "_after",
        "_before",
        F.when((start <= F.col("_k0")) & (F.col("_k0") <= end), F.col("_v")).alias("_x0"),
        F.when((start <= F.col("_k0") + 1) & (F.col("_k0") + 1 <= end), F.col("_v")).alias("_x1"),
    )
    g = picks.groupBy(*by, "p").agg(
        F.max("_x0").alias("_x0"),
        F.max("_x1").alias("_x1"),
        F.first("_h").alias("_h"),
        F.first("_k0").alias("_k0"),
        F.first("_after").alias("_after"),
        F.first("_before").alias("_before"),
    )
    frac = F.col("_h") - F.col("_k0")
    # rank k0+1 outside the band is the first value after it; at p = 1 there is none
    x0 = F.coalesce(F.col("_x0"), F.col("_before"))
    x1 = F.coalesce(F.col("_x1"), F.col("_after"), x0)
    return g.select(*by, "p", (x0 + frac * (x1 - x0)).alias("percentile"))


def exact_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    m = exact_percentiles(df, by, value, [0.5])
    return m.select(*by, F.col("percentile").alias(out))
