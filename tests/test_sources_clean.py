"""CSV source + cleaning chain on files written from the test tables."""

import os
import tempfile

from pyspark.sql import functions as F

from candleframe.operators import clean as CL
from candleframe.sources.candles_csv import read_candles_csv, reject_corrupt_files


def _write_csvs(bars):
    pdf = bars.toPandas()
    d = tempfile.mkdtemp(prefix="cf-csv-", dir="/tmp")
    for sym, g in pdf.groupby("symbol"):
        g = g.sort_values("ts")
        out = g.assign(Timestamp=(g["ts"].astype("int64") // 10**6))  # epoch ms
        out = out.rename(columns={"open": "OPEN", "high": "High", "low": "low", "close": "Close", "volume": "VOLUME"})
        out["datetime"] = g["ts"].dt.strftime("%Y-%m-%d %H:%M:%S")
        out[["Timestamp", "OPEN", "High", "low", "Close", "VOLUME", "datetime"]].to_csv(os.path.join(d, f"{sym}.csv"), index=False)
    # junk values in one file
    with open(os.path.join(d, "view.csv"), "a") as fh:
        fh.write("1706659200000,abc,1,1,1,1,2024-01-31 00:00:00\n")
    return d


def test_csv_to_clean_candles(spark, bars):
    d = _write_csvs(bars)
    raw = read_candles_csv(spark, d)
    assert set(raw.columns) >= {"timestamp", "open", "close", "symbol", "_corrupt_record"}
    clean = CL.coerce_numeric(raw)
    clean = CL.epoch_ms_to_s(clean, "timestamp")
    clean = CL.epoch_to_datetime(clean, "timestamp", "ts")
    nulls = CL.null_report(clean).filter(F.col("symbol") == "view").collect()[0]
    assert nulls["null_open"] == 1
    kept = CL.drop_null_rows(clean)
    assert kept.count() == bars.count() + 1 - 1 + 0  # junk row dropped, the rest kept
    joined = kept.join(bars.select("symbol", "ts", F.col("close").alias("c0")), ["symbol", "ts"])
    assert joined.filter(F.abs(F.col("close") - F.col("c0")) > 1e-9).count() == 0
    assert joined.count() == bars.count()
    strict = CL.reject_non_numeric(clean)
    assert strict.filter(F.col("symbol") == "view").count() == 0
    assert reject_corrupt_files(raw).count() > 0


def test_min_rows_gate_and_tail(spark, bars):
    counts = {r["symbol"]: r["n"] for r in bars.groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    gate = max(counts.values())
    kept = CL.min_rows_gate(bars, gate).select("symbol").distinct().collect()
    assert {r["symbol"] for r in kept} == {s for s, n in counts.items() if n >= gate}
    t = CL.tail_n(bars, 7).groupBy("symbol").count().collect()
    assert all(r["count"] == min(7, counts[r["symbol"]]) for r in t)
