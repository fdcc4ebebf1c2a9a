"""Structured Streaming: ticks -> bars, per-symbol stateful EMA, signal-change alerts.

Event time is a TIMESTAMP column (``withWatermark`` rejects TIMESTAMP_NTZ, so NTZ input is
cast under the session time zone). Windows are emitted in append mode once the
watermark passes their end; later ticks for a closed window are dropped by Spark.
Checkpoints live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import sys

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ensure_checkpoint_dir

# Functions of this module run inside Python workers; pickle them by value so a worker
# does not need the package on its path (ship it with --py-files on a cluster anyway).
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tick_stream(spark: SparkSession, sf_dir: str, table: str = "events", max_files_per_trigger: int | None = None) -> DataFrame:
    """The table ``<table>.parquet``, a file or a folder of part files, as a tick stream
    (symbol, ts, seq, price, qty); new files in a folder are picked up by later triggers."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # A stream takes a folder or a pattern, not one file; this pattern is met by either.
    ev = r.parquet(f"{path[:-1]}?")
    return ev.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.col("value").alias("qty"),
    )


def stream_bars(ticks: DataFrame, period: str = "1 hour", slide: str | None = None, watermark: str = "2 hours") -> DataFrame:
    """OHLCV bars per (symbol, window); ``slide`` gives sliding windows."""
    win = F.window("ts", period, slide) if slide else F.window("ts", period)
    key = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", watermark)
        .groupBy("symbol", win.alias("w"))
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("qty").alias("volume"),
            F.count(F.lit(1)).alias("n_ticks"),
        )
        .select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("ts_end"), "open", "high", "low", "close", "volume", "n_ticks")
    )


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")


def run_available(df: DataFrame, name: str) -> DataFrame:
    """Run a streaming query over all currently available input (availableNow trigger)
    into Parquet files in the session's checkpoint folder and return them as a batch DataFrame."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-output/{name}-{uuid.uuid4().hex}"
    return spark.read.schema(df.schema).parquet(write_stream_parquet(df, name, path))


# ---------------------------------------------------------------------------
# Stateful per-symbol EMA across micro-batches


EMA_OUT = "symbol string, ts timestamp, close double, ema double, late boolean"
EMA_STATE = "y double, last_ts timestamp, n long"


def _ema_fn(alpha: float, min_periods: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            y, last_ts, n = state.get
        else:
            y, last_ts, n = None, None, 0
        parts = [p for p in pdfs]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values("ts", kind="stable")
        out_y, late = [], []
        for ts, c in zip(pdf["ts"], pdf["close"]):
            if last_ts is not None and ts <= last_ts:
                out_y.append(None)
                late.append(True)
                continue
            y = c if y is None else (1.0 - alpha) * y + alpha * c
            n += 1
            last_ts = ts
            out_y.append(y if n >= min_periods else None)
            late.append(False)
        state.update((y, last_ts, n))
        yield pd.DataFrame({"symbol": key[0], "ts": pdf["ts"].values, "close": pdf["close"].values, "ema": out_y, "late": late})

    return fn


def stream_ema(bars: DataFrame, span: int = 20, warmup: bool = True) -> DataFrame:
    """EMA(span) per symbol over a bar stream, state = (last value, last ts, count).
    Bars must arrive in time order per symbol; a bar at or before the last processed ts
    is flagged ``late`` and not applied (recomputing history is out of scope)."""
    alpha = 2.0 / (span + 1)
    return bars.groupBy("symbol").applyInPandasWithState(
        _ema_fn(alpha, span if warmup else 1), EMA_OUT, EMA_STATE, "append", GroupStateTimeout.NoTimeout
    )


def write_stream_parquet(df: DataFrame, name: str, path: str) -> str:
    """Append a stream to a parquet folder (exactly-once file sink) over all available
    input; returns the folder. Used to chain stateful stages."""
    spark = df.sparkSession
    q = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint_location(spark, name))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return path


def bar_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder)


LAST_SIDE = "symbol string, ts timestamp, side double"


def cross_alerts(sides_path: str, alerts_path: str):
    """foreachBatch handler over an EMA stream: a bar is an alert when the side of close
    vs EMA (above / below) differs from the symbol's previous bar.

    Each epoch writes its own folders, with overwrite, so a batch that is run again leaves
    the same files: its alerts, and the last side of each symbol (one row per symbol), which
    the next epoch reads as the bars before its own."""
    from pyspark.sql import Window

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        cur = batch.filter(~F.col("late") & F.col("ema").isNotNull()).select("symbol", "ts", F.signum(F.col("close") - F.col("ema")).alias("side"))
        if epoch:
            last = spark.read.schema(LAST_SIDE).parquet(f"{sides_path}/epoch={epoch - 1}")
        else:
            last = spark.createDataFrame([], LAST_SIDE)
        rows = cur.withColumn("_old", F.lit(False)).unionByName(last.withColumn("_old", F.lit(True)))
        w = Window.partitionBy("symbol").orderBy("ts")
        ch = rows.withColumn("prev_side", F.lag("side").over(w)).filter(~F.col("_old") & (F.col("prev_side") != F.col("side")))
        ch.select("symbol", "ts", "side", "prev_side").write.mode("overwrite").parquet(f"{alerts_path}/epoch={epoch}")
        now = cur.unionByName(last).groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("side", "ts").alias("side"))
        now.write.mode("overwrite").parquet(f"{sides_path}/epoch={epoch}")

    return handle


def run_alerts(ema_stream: DataFrame, base: str, name: str = "alerts") -> str:
    spark = ema_stream.sparkSession
    sides, alerts = f"{base}/sides", f"{base}/alerts"
    q = (
        ema_stream.writeStream.foreachBatch(cross_alerts(sides, alerts))
        .option("checkpointLocation", checkpoint_location(spark, name))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return alerts
