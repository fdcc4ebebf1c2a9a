"""Parquet table access and the tick view of the driver's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_as_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table seen as a tick stream.

    symbol = event_type, price = value, qty = value (the test tables carry no size),
    seq = event_id (unique tiebreak for equal timestamps).
    Only the five needed columns are read (column pruning reaches the scan).
    """
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("symbol"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.col("value").alias("qty"),
    )
