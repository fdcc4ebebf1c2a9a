"""Re-aimed per-series forecasters as Spark jobs.

``seasonal_trend_forecast`` replaces a per-series Prophet fit: a least-squares trend on
the bar index (``regr_slope`` / ``regr_intercept``, partial aggregation) plus the mean
residual by hour of day. ``ewma_variance_vote`` replaces a GARCH(1,1) fit with the
RiskMetrics variance recursion (lambda 0.94) through the distributed scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import latest_row
from .joins import join_small
from .scan import Recurrence, linear_scan
from .series import RN, Layout

RISKMETRICS_LAMBDA = 0.94


def seasonal_trend_forecast(f: DataFrame, bar: str = "1 hour") -> DataFrame:
    """Per symbol: trend a + b * _rn fitted on close; seasonal term = mean residual of the
    hour of day; forecast for the next bar (index n, hour of last ts + one bar); 'up' when
    the forecast exceeds the last close."""
    x = F.col(RN).cast("double")
    fit = f.groupBy("symbol").agg(
        F.regr_slope("close", x).alias("slope"),
        F.regr_intercept("close", x).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )
    r = join_small(f, fit, "symbol", "inner").withColumn(
        "resid", F.col("close") - (F.col("intercept") + F.col("slope") * x)
    )
    season = r.groupBy("symbol", F.hour("ts").alias("hour")).agg(F.avg("resid").alias("seasonal"))
    last = latest_row(f.select("symbol", "ts", "close")).withColumn("next_ts", F.col("ts") + F.expr(f"INTERVAL {bar}"))
    nxt = join_small(last, fit, "symbol", "inner").withColumn("hour", F.hour("next_ts"))
    out = nxt.join(season, ["symbol", "hour"], "left").withColumn(
        "forecast",
        F.col("intercept") + F.col("slope") * F.col("n").cast("double") + F.coalesce(F.col("seasonal"), F.lit(0.0)),
    )
    return out.select(
        "symbol",
        "next_ts",
        "slope",
        "forecast",
        F.when(F.col("forecast") > F.col("close"), "up").otherwise("down").alias("direction"),
    )


def ewma_variance(f: DataFrame, layout: Layout) -> DataFrame:
    """sigma2[t] = lambda * sigma2[t-1] + (1 - lambda) * r[t]^2, seeded with r^2 at the
    first return (row 1)."""
    lam = RISKMETRICS_LAMBDA
    r2 = F.col("returns") * F.col("returns")
    rn = F.col(RN)
    a = F.when((rn <= 1) | r2.isNull(), F.lit(1.0)).otherwise(F.lit(lam))
    c = F.when((rn < 1) | r2.isNull(), F.lit(0.0)).when(rn == 1, r2).otherwise(F.lit(1.0 - lam) * r2)
    return linear_scan(f, layout, [Recurrence("ewma_var", a, c, rn >= 1)])


def ewma_variance_vote(f: DataFrame, layout: Layout) -> DataFrame:
    """Latest EWMA variance vs the median squared return of the series: above -> 'up'
    (volatility expansion vote), else 'down'."""
    v = ewma_variance(f, layout)
    from .aggregates import median_sq_return

    med = median_sq_return(f)
    last = v.groupBy("symbol").agg(F.max_by("ewma_var", RN).alias("ewma_var"))
    j = last.join(med, "symbol")
    return j.withColumn("vote", F.when(F.col("ewma_var") > F.col("median_sq_return"), "up").otherwise("down"))
