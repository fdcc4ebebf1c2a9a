"""A total order over all rows, and a roll-up of the rules' signals, both without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def total_order(df: DataFrame, cols: Sequence[str], out: str = "row") -> DataFrame:
    """``df`` with the row's place (from 0) in the order of ``cols``, nulls first, and in that order.

    Rows are range-partitioned, numbered in their partition and moved by the sizes of the partitions before; only
    these sizes meet in one task. ``cols`` should name rows uniquely: equal rows are numbered in any order, and
    a run of equal rows stays in one partition."""
    ensure_checkpoint_dir(df.sparkSession)
    # The checkpoint fixes the sampled ranges, so that the sizes and the numbers are of the same partitions.
    parts = df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*cols)) - 1
    return parts.withColumn("_place", place).join(starts, "_part").withColumn(out, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def signal_rollup(signals: DataFrame, names: Sequence[str], by: str = "symbol") -> DataFrame:
    """(symbol, strategy, level, n_bars, n_buy, n_sell): per pair (level 0), per symbol (1) and in all (3).

    ``signals`` holds one column ``sig_<name>`` (1, -1 or 0) for each rule. The bars are counted once, on the wide
    rows; the grouping sets run on the (symbol, rule) counts."""
    counts = [F.count_if(F.col(f"sig_{n}") == side).alias(f"{what}_{n}") for n in names for what, side in (("b", 1), ("s", -1))]
    wide = signals.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *counts)
    pairs = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"b_{n}").alias("b"), F.col(f"s_{n}").alias("s")) for n in names])
    long = wide.select(by, "_n", F.inline(pairs))
    return long.rollup(by, "strategy").agg(F.grouping_id().alias("level"), F.sum("_n").alias("n_bars"), F.sum("b").alias("n_buy"), F.sum("s").alias("n_sell"))
