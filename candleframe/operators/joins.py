"""Joins against small, data-derived tables (per-series counts, maxima, block carries).

The small side is always an aggregate, so its size is only known once it has run. No
``broadcast()`` hint and no eager ``count()`` (which would execute the aggregate's whole
lineage, including the scan of the big table, a second time): with adaptive execution the
small side's shuffle stage is materialised first and Spark broadcasts it only when its
measured size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``; above that the
join stays a sort-merge join whose skewed partitions AQE splits. Explicit ``broadcast()``
is kept for constant dimension tables only (descriptions, weights, registry).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_small(big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    return big.join(small, on, how)


def semi_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return join_small(df, keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return join_small(df, keys, on, "left_anti")
