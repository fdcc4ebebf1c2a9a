"""A per-symbol EMA over bars that arrive out of order, put in order by event time.

A bar waits in the symbol's map state until the watermark has passed it; its timer then
fires, in the order of the bars' times, and the recurrence takes it. Bars that arrive in any
order inside the watermark therefore give the batch result. A bar behind a bar that was already
taken is returned marked late and not applied. A batch is taken piece by piece; what is held for
a symbol is one entry for each waiting bar, bounded by the watermark's delay.

The state is kept by RocksDB: ``run_arrivals`` names that provider for its queries and restores the
session's own afterwards. Times of bars are whole milliseconds, which is what timers count in; two
bars of one symbol with one time are one bar, the later arrival.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .bars import EMA_OUT

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class OrderedEma(StatefulProcessor):
    def __init__(self, alpha: float, min_periods: int):
        self.alpha, self.min_periods = alpha, min_periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "y double, at long, n long")
        self.waiting = handle.getMapState("waiting", "at long", "close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.now.get()[1] if self.now.exists() else None
        for piece in rows:
            late = []
            for ts, close in zip(piece["ts"], piece["close"], strict=True):
                at = _millis(ts)
                if taken is not None and at <= taken:
                    late.append((key[0], ts, close, None, True))
                    continue
                self.waiting.updateValue((at,), (float(close),))
                self.handle.registerTimer(at)
            if late:
                yield pd.DataFrame(late, columns=["symbol", "ts", "close", "ema", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((at,)):
            close = self.waiting.getValue((at,))[0]
            self.waiting.removeKey((at,))
            y, _, n = self.now.get() if self.now.exists() else (None, None, 0)
            y = close if y is None else (1.0 - self.alpha) * y + self.alpha * close
            self.now.update((y, at, n + 1))
            ema = y if n + 1 >= self.min_periods else None
            yield pd.DataFrame({"symbol": [key[0]], "ts": [pd.Timestamp(at, unit="ms")], "close": [close], "ema": [ema], "late": [False]})

    def close(self) -> None:
        pass


def stream_ema_ordered(bars: DataFrame, span: int = 20, watermark: str = "1 day", warmup: bool = True) -> DataFrame:
    """EMA(span) per symbol of a bar stream (symbol, ts, close) that may be out of order within ``watermark``."""
    processor = OrderedEma(2.0 / (span + 1), span if warmup else 1)
    rows = bars.select("symbol", "ts", "close").withWatermark("ts", watermark).groupBy("symbol")
    return rows.transformWithStateInPandas(processor, EMA_OUT, "Append", "EventTime")


def run_arrivals(spark: SparkSession, arrivals: Iterable[DataFrame], folder: str, out: str, location: str, span: int = 20, watermark: str = "2 days", warmup: bool = True) -> DataFrame:
    """The ordered EMA over arrivals of bars, one after the other, from one checkpoint, as Parquet.

    Each arrival is written to a folder that the stream watches; the stream is started again for
    what is new and finds its state and watermark where it left them."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        for k, part in enumerate(arrivals):
            part.write.mode("overwrite").parquet(f"{folder}/part-{k:05d}")
            ema = stream_ema_ordered(spark.readStream.schema(part.schema).parquet(f"{folder}/*"), span, watermark, warmup)
            sink = ema.writeStream.outputMode("append").format("parquet").option("path", out)
            sink.option("checkpointLocation", location).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(EMA_OUT).parquet(out)
