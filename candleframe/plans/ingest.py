"""Registered queries: candle CSV uploads with junk, two encodings, milliseconds and missing headers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import candle_files as CF
from . import oracle_sql as Q
from .catalog import bars_1h, r6, register

# How each symbol's upload is spoiled: rules of the bar's hour and day, in Spark and in SQL alike.
_SHAPE_SQL = (
    f"WITH {Q.BARS_1H}, u AS (SELECT symbol, ts, open, high, low, close, volume, CASE symbol WHEN 'click' THEN 'ms' WHEN 'error' THEN 'latin' WHEN 'purchase' THEN 'bare' ELSE 'plain' END AS kind, "
    "hour(ts) = 5 AS junk, hour(ts) = 9 AS gap, hour(ts) = 13 AS short FROM bars) "
)


def _uploads(spark: SparkSession, sf_dir: str) -> str:
    """The bars as CSV files: ``click`` in ms with an upper-case header, ``error`` in Latin-1 with its columns
    turned round and a note, ``purchase`` without a header; in all of them junk prices at 5 o'clock, empty
    volumes at 9, and a field too few at 13."""
    b = bars_1h(spark, sf_dir)
    junk, gap, short = (F.hour("ts") == h for h in (5, 9, 13))
    text = lambda c: F.col(c).cast("string")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    epoch = F.when(F.col("symbol") == "click", seconds * 1000).otherwise(seconds).cast("string")
    close = F.when(junk, "n/a").otherwise(text("close"))
    volume = F.when(gap, "").otherwise(text("volume"))
    plain = F.concat_ws(",", epoch, text("open"), text("high"), text("low"), close, volume)
    turned = F.concat_ws(",", volume, close, text("low"), text("high"), text("open"), F.lit('"café, ""olé"""'), epoch)
    line = F.when(F.col("symbol") == "error", turned).otherwise(plain)
    line = F.when(short, F.regexp_replace(line, ",[^,]*$", "")).otherwise(line)
    rows = b.select("symbol", line.alias("line"))
    base = f"{ensure_checkpoint_dir(spark)}/uploads-{uuid.uuid4().hex[:8]}"
    head = {"error": "Volume,Close,Low,High,Open,Note,Timestamp", "click": "TIMESTAMP,OPEN,HIGH,LOW,CLOSE,VOLUME"}
    options = {"quote": "\u0000", "escape": "\u0000", "sep": "\u0001", "header": True, "emptyValue": ""}
    for kind in ("click", "error", "purchase", "rest"):
        part = rows.filter(~F.col("symbol").isin("click", "error", "purchase") if kind == "rest" else F.col("symbol") == kind)
        named = head.get(kind, "timestamp,open,high,low,close,volume")
        w = part.withColumnRenamed("line", named).write.partitionBy("symbol").mode("append").options(**options)
        w = w.option("header", kind != "purchase").option("encoding", "ISO-8859-1" if kind == "error" else "UTF-8")
        w.csv(f"{base}/{kind}")
    return base


def _records(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    records = CF.read_uploads(spark, f"{_uploads(spark, sf_dir)}/*/*", strict=strict)
    return records.withColumn("symbol", F.regexp_extract("file", "symbol=([^/]*)", 1))


@register(
    "ingest_candles",
    f"{_SHAPE_SQL} SELECT symbol, ts, CASE kind WHEN 'latin' THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding, epoch(ts)::DOUBLE AS \"timestamp\", {Q.r6('open', 'open')}, {Q.r6('high', 'high')}, {Q.r6('low', 'low')}, "
    f"{Q.r6('CASE WHEN NOT junk THEN close END', 'close')}, {Q.r6('CASE WHEN NOT gap THEN volume END', 'volume')} FROM u WHERE kind <> 'bare' AND NOT short",
)
def q_ingest_candles(spark, sf_dir):
    """Records of the upload path: junk and empty numbers become null; records that do not fit the header go."""
    k = CF.kept(_records(spark, sf_dir, strict=False))
    return k.select("symbol", F.col("datetime").alias("ts"), "encoding", "timestamp", *[r6(c) for c in ("open", "high", "low", "close", "volume")])


@register(
    "ingest_quarantine",
    f"{_SHAPE_SQL} SELECT symbol, CASE WHEN kind = 'bare' THEN 'no header' WHEN short THEN 'field count' WHEN junk THEN 'not a number: close' ELSE 'not a number: volume' END AS reason, count(*) AS n "
    "FROM u WHERE kind = 'bare' OR short OR junk OR gap GROUP BY ALL",
)
def q_ingest_quarantine(spark, sf_dir):
    """Records that the strict path rejects, by reason."""
    records = _records(spark, sf_dir, strict=True)
    return records.filter(F.col("reason").isNotNull()).groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("n"))
