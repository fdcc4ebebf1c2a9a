"""Streams read folder tables, and a batch that runs again leaves the same alerts."""

from pyspark.sql import functions as F

from candleframe.streaming import bars as ST

SF0001 = "/root/testdata/sf0.001"


def test_folder_table_gives_the_same_bars(spark, tmp_path):
    events = spark.read.parquet(f"{SF0001}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    rows = lambda d: sorted(tuple(r) for r in ST.run_available(ST.stream_bars(ST.tick_stream(spark, d)), "bars").select("symbol", "ts", "close", "n_ticks").collect())
    one = rows(SF0001)
    assert one and rows(str(tmp_path)) == one


def test_replayed_batch_leaves_the_same_alerts(spark, tmp_path):
    rows = [("a", 1, 2.0, 1.0), ("a", 2, 0.5, 1.0), ("b", 1, 0.5, 1.0)], [("a", 3, 3.0, 1.0), ("b", 2, 0.6, 1.0), ("b", 3, 2.0, 1.0)]
    frames = [spark.createDataFrame([(s, t, c, e) for s, t, c, e in part], "symbol string, t long, close double, ema double") for part in rows]
    frames = [f.select("symbol", F.timestamp_seconds("t").alias("ts"), "close", "ema", F.lit(False).alias("late")) for f in frames]

    handle = ST.cross_alerts(str(tmp_path / "sides"), str(tmp_path / "alerts"))
    read = lambda: sorted((r.symbol, int(r.ts.timestamp()), r.side, r.prev_side) for r in spark.read.parquet(str(tmp_path / "alerts")).collect())
    handle(frames[0], 0)
    handle(frames[1], 1)
    first = read()
    handle(frames[1], 1)
    assert read() == first == [("a", 2, -1.0, 1.0), ("a", 3, 1.0, -1.0), ("b", 3, 1.0, -1.0)]
