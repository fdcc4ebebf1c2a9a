"""Headline benchmark: per-query wall time on 5-minute bars built from ``events``.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line. Each query is forced to completion with the ``noop`` sink
(full computation, no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from candleframe.functions import signals as SG  # noqa: E402
from candleframe.functions.indicators import features  # noqa: E402
from candleframe.operators import aggregates as AG  # noqa: E402
from candleframe.operators import consensus as CS  # noqa: E402
from candleframe.operators.bars import fixture_bars  # noqa: E402
from candleframe.operators.series import drop_layout  # noqa: E402
from candleframe.session import local_session  # noqa: E402
from candleframe.sources.tables import events_as_ticks  # noqa: E402
from candleframe.streaming import bars as ST  # noqa: E402

PERIOD = "5 minutes"


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(cpus, 8))
    ticks = events_as_ticks(spark, sf_dir)

    def bars():
        return fixture_bars(ticks, PERIOD)

    rolling = ["sma_20", "bb_upper", "bb_lower", "rsi_simple", "cci", "stoch_d", "williams_r", "mfi", "cmf", "aroon_osc"]
    recursive = ["ema_12", "ema_26", "macd", "macd_signal", "rsi", "atr", "adx", "kama", "obv", "vwap", "mass_index"]
    sig_cols = ["symbol", "ts", *[f"sig_{n}" for n, _, _ in SG.STRATEGY_RULES], "combined_signal", "market_direction"]

    def ind(cols):
        return features(bars(), cols).select("symbol", "ts", *cols)

    queries = {
        "bars_5m": lambda: bars(),
        "rolling_indicators": lambda: ind(rolling),
        "recursive_indicators": lambda: ind(recursive),
        "strategy_signals": lambda: SG.with_strategy_signals(drop_layout(features(bars(), SG.strategy_columns()))).select(*sig_cols),
        "paired_strategies": lambda: SG.paired_long(drop_layout(features(bars(), SG.paired_columns())), ["symbol", "ts"]),
        "consensus_weighted": lambda: CS.consensus_weighted(CS.strategy_votes(SG.with_strategy_signals(features(bars(), [*SG.strategy_columns(), "delta_close"])))),
        "stream_bars": lambda: ST.run_available(ST.stream_bars(ST.tick_stream(spark, sf_dir), PERIOD), "bench_bars"),
        "series_aggregates": lambda: AG.pressure_range(bars()).join(AG.pressure_body(bars()), "symbol"),
    }
    # warm-up: JVM, Python workers
    run(bars().limit(1))
    times = {}
    for name, q in queries.items():
        t0 = time.time()
        run(q())
        times[name] = round(time.time() - t0, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "bar_period": PERIOD,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
