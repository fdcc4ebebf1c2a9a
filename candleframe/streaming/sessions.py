"""Tick sessions, and ticks that arrive behind the watermark counted instead of lost.

``stream_sessions`` groups the ticks of a symbol whose distance is at most a gap, with Spark's
session windows under a watermark; a session comes out once the watermark has passed its end.

Spark drops rows behind the watermark in a stateful operator without a trace. ``LateSplit`` is
the side output: it runs as a ``foreachBatch`` sink before any state, applies the same rule (the
watermark of a batch is the latest time in all earlier batches less the delay) to each tick, and
writes every tick, marked. Each epoch writes its own folders with overwrite, so a batch
that runs again leaves the same files, and on-time and late ticks add up to the input.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import checkpoint_location


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes", watermark: str = "2 hours") -> DataFrame:
    """(symbol, start, end, n_ticks, low, high, volume) of each closed session; ``end`` is the last tick plus the gap."""
    return (
        ticks.withWatermark("ts", watermark)
        .groupBy("symbol", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_ticks"), F.min("price").alias("low"), F.max("price").alias("high"), F.sum("qty").alias("volume"))
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_ticks", "low", "high", "volume")
    )


class LateSplit:
    """``foreachBatch`` handler that writes the ticks of each epoch with ``late``, under ``base``."""

    def __init__(self, base: str, delay: str, ts: str = "ts"):
        self.base, self.delay, self.ts = base, delay, ts

    def _latest(self, spark: SparkSession, epoch: int):
        if epoch == 0:
            return None
        return spark.read.schema("latest timestamp").parquet(f"{self.base}/latest/epoch={epoch - 1}").first().latest

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = F.lit(self._latest(spark, epoch)).cast("timestamp")
        watermark = before - F.expr(f"INTERVAL {self.delay}")
        marked = batch.withColumn("late", F.coalesce(F.col(self.ts) < watermark, F.lit(False)))
        path = f"{self.base}/ticks/epoch={epoch}"
        marked.write.mode("overwrite").parquet(path)
        # read back what was written: the batch's source is read once
        now = spark.read.schema(marked.schema).parquet(path).agg(F.greatest(F.max(self.ts), before).alias("latest"))
        now.write.mode("overwrite").parquet(f"{self.base}/latest/epoch={epoch}")


def split_arrivals(spark: SparkSession, arrivals: Iterable[DataFrame], base: str, delay: str, name: str = "late") -> DataFrame:
    """Run arrivals, one after the other, through the side output; ticks with ``epoch`` and ``late``.

    Each arrival is written to a folder that the stream watches, and the stream is started from its
    checkpoint for what is new, as a scheduled job would."""
    folder, location = f"{base}/arrivals", checkpoint_location(spark, name)
    schema = None
    for k, part in enumerate(arrivals):
        schema = part.schema
        part.write.mode("overwrite").parquet(f"{folder}/part-{k:05d}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*")
        q = stream.writeStream.foreachBatch(LateSplit(base, delay)).option("checkpointLocation", location).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.option("basePath", f"{base}/ticks").schema(schema.add("late", "boolean").add("epoch", "integer")).parquet(f"{base}/ticks")
