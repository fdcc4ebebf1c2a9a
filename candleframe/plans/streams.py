"""Registered queries: sessions, late ticks, and an EMA over bars out of order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import events_as_ticks
from ..streaming import bars as ST
from ..streaming import ordered as OR
from ..streaming import sessions as SE
from . import oracle_sql as Q
from .catalog import _EMA_ALPHA, _WM_SQL, bars_1h, r6, register

ARRIVALS, DELAY = 4, "6 hours"


@register(
    "stream_sessions",
    "WITH t AS (SELECT event_type AS symbol, ts, value, coalesce(ts > lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) + INTERVAL 30 MINUTE, true) AS fresh, event_id FROM events), "
    "s AS (SELECT *, count_if(fresh) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM t) "
    f"SELECT symbol, min(ts) AS ts, max(ts) + INTERVAL 30 MINUTE AS ts_end, count(*) AS n_ticks, {Q.r6('min(value)', 'low')}, {Q.r6('max(value)', 'high')}, {Q.r6('sum(value)', 'volume')} "
    f"FROM s GROUP BY symbol, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_WM_SQL}",
)
def q_stream_sessions(spark, sf_dir):
    """Sessions of ticks at most 30 minutes apart, closed by the watermark."""
    s = SE.stream_sessions(ST.tick_stream(spark, sf_dir), "30 minutes", "2 hours")
    out = ST.run_available(s, "stream_sessions")
    ntz = lambda c, name: F.col(c).cast("timestamp_ntz").alias(name)
    return out.select("symbol", ntz("start", "ts"), ntz("end", "ts_end"), "n_ticks", *[r6(c) for c in ("low", "high", "volume")])


@register(
    "stream_late_ticks",
    f"WITH a AS (SELECT event_type AS symbol, ts, (event_id * {ARRIVALS}) // ((SELECT max(event_id) FROM events) + 1) AS arrival FROM events), "
    "w AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 6 HOUR AS watermark FROM a GROUP BY arrival) "
    "SELECT symbol, a.arrival::INTEGER AS arrival, count(*) AS n_ticks, count_if(coalesce(ts < watermark, false)) AS n_late, count(*) - n_late AS n_on_time "
    "FROM a JOIN w ON w.arrival = a.arrival GROUP BY symbol, a.arrival",
)
def q_stream_late_ticks(spark, sf_dir):
    """The ticks in four arrivals by event number; those behind the watermark of their arrival are counted."""
    ticks = events_as_ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    top = ticks.agg(F.max("seq")).first()[0]
    part = F.floor(F.col("seq") * ARRIVALS / F.lit((top or 0) + 1))
    base = f"{ensure_checkpoint_dir(spark)}/late-{uuid.uuid4().hex[:8]}"
    split = SE.split_arrivals(spark, (ticks.filter(part == k) for k in range(ARRIVALS)), base, DELAY)
    counts = split.groupBy("symbol", F.col("epoch").alias("arrival")).agg(F.count(F.lit(1)).alias("n_ticks"), F.count_if("late").alias("n_late"))
    return counts.withColumn("n_on_time", F.col("n_ticks") - F.col("n_late"))


@register(
    "stream_ema_ordered",
    f"WITH RECURSIVE {Q.BARS_1H}, cb AS (SELECT symbol, ts, close, rn FROM b WHERE ts <= (SELECT max(ts) FROM bars) - INTERVAL 2 DAY), "
    "r AS (SELECT symbol, rn, ts, close, close AS y FROM cb WHERE rn = 0 UNION ALL "
    f"SELECT c.symbol, c.rn, c.ts, c.close, {1.0 - _EMA_ALPHA!r} * r.y + {_EMA_ALPHA!r} * c.close FROM r JOIN cb c ON c.symbol = r.symbol AND c.rn = r.rn + 1) "
    f"SELECT symbol, ts, {Q.r6('close', 'close')}, {Q.r6('CASE WHEN rn >= 19 THEN y END', 'ema')} FROM r",
)
def q_stream_ema_ordered(spark, sf_dir):
    """EMA over hourly bars of which every second one arrives a day late, within the watermark of two days."""
    bars = bars_1h(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close").checkpoint(eager=True)
    base = f"{ensure_checkpoint_dir(spark)}/disorder-{uuid.uuid4().hex[:8]}"
    day = F.unix_seconds("ts") / 86_400
    arrival = F.floor((F.floor(day) + F.hour("ts") % 2) / 8)
    first, last = bars.agg(F.min(arrival), F.max(arrival)).first()
    location, out = ST.checkpoint_location(spark, "ordered"), f"{base}/out"
    return OR.run_arrivals(spark, (bars.filter(arrival == k) for k in range(first or 0, (last or -1) + 1)), f"{base}/in", out, location).filter(~F.col("late")).select(
        "symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("close"), r6("ema")
    )
