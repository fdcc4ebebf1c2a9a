"""Sessions, late ticks counted, and an EMA over bars out of order that equals the batch one."""

from pyspark.sql import functions as F

from candleframe.streaming import bars as ST
from candleframe.streaming import ordered as OR
from candleframe.streaming import sessions as SE


def ticks(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, t long, price double")
    return df.select("symbol", F.timestamp_seconds("t").alias("ts"), F.monotonically_increasing_id().alias("seq"), "price", F.col("price").alias("qty"))


def test_late_ticks_are_kept_and_counted(spark, tmp_path):
    parts = [[("a", 100, 1.0), ("b", 5000, 2.0)], [("a", 1399, 3.0), ("a", 1400, 4.0), ("b", 9000, 5.0), ("b", 10, 6.0)], [], [("a", 5399, 7.0), ("a", 5400, 8.0)]]
    out = SE.split_arrivals(spark, [ticks(spark, p) for p in parts], str(tmp_path), "1 hour").collect()
    assert len(out) == sum(map(len, parts))
    assert sorted(r.price for r in out if r.late) == [3.0, 6.0, 7.0]
    late = SE.LateSplit(str(tmp_path), "1 hour")
    replay = ticks(spark, parts[1])
    late(replay, 1)  # the same epoch again leaves the same rows
    again = spark.read.parquet(f"{tmp_path}/ticks").collect()
    assert sorted((r.price, r.late, r.epoch) for r in again) == sorted((r.price, r.late, r.epoch) for r in out)


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    rows = [("a", 0, 1.0), ("a", 600, 5.0), ("a", 1200, 2.0), ("a", 1801, 3.0), ("b", 50, 4.0), ("a", 100000, 9.0)]
    ticks(spark, rows).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "t")).schema).parquet(str(tmp_path / "t"))
    got = ST.run_available(SE.stream_sessions(stream, "10 minutes", "1 hour"), "sessions").collect()
    seen = sorted((r.symbol, int(r.start.timestamp()), int(r.end.timestamp()), r.n_ticks, r.low, r.high, r.volume) for r in got)
    assert seen == [("a", 0, 1800, 3, 1.0, 5.0, 8.0), ("a", 1801, 2401, 1, 3.0, 3.0, 3.0), ("b", 50, 650, 1, 4.0, 4.0, 4.0)]


def test_ordered_ema_equals_batch(spark, tmp_path):
    hour, n = 3600, 40  # times begin at one hour: the watermark of an empty stream is 0
    close = {s: [10.0 + (k * k * 7 + len(s)) % 23 for k in range(n)] for s in ("a", "bb")}
    order = [k for k in range(n) if k % 5 != 2]
    held = [k for k in range(n) if k % 5 == 2]  # these arrive after bars up to ten hours later
    arrivals = []
    for lo in range(0, n, 10):
        now = [k for k in order if lo <= k < lo + 10][::-1] + [k for k in held if lo - 10 <= k < lo]
        arrivals.append([(s, k) for k in now for s in close])
    arrivals.append([(s, k) for k in held if k >= n - 10 for s in close] + [("a", n + 60), ("a", 3)])
    close["a"] += [0.0] * 61
    frames = [spark.createDataFrame([(s, (k + 1) * hour, close[s][k]) for s, k in part], "symbol string, t long, close double").select("symbol", F.timestamp_seconds("t").alias("ts"), "close") for part in arrivals]
    out = OR.run_arrivals(spark, frames, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), span=4, watermark="1 day")
    rows = out.collect()
    late = [r for r in rows if r.late]
    assert all((r.symbol, int(r.ts.timestamp()) // hour - 1) == ("a", 3) for r in late)
    for s in ("a", "bb"):
        y, want = None, []
        for k in range(n):
            y = close[s][k] if y is None else 0.6 * y + 0.4 * close[s][k]
            want.append((k, None if k < 3 else round(y, 9)))
        got = sorted((int(r.ts.timestamp()) // hour - 1, None if r.ema is None else round(r.ema, 9)) for r in rows if r.symbol == s and not r.late)
        assert got == want
