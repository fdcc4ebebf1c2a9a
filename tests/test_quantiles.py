"""Exact band-based percentiles equal Spark's exact percentile (ties, skewed groups)."""

import numpy as np
from pyspark.sql import functions as F

from candleframe.operators.quantiles import exact_percentiles


def test_exact_percentiles_match_spark_percentile(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.normal(0, 1, 30000)]
    rows += [("ties", float(x)) for x in rng.integers(0, 5, 5000)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r["g"], r["p"]): r["percentile"] for r in exact_percentiles(df, ["g"], "x", probs, accuracy=500).collect()}
    ref = df.groupBy("g").agg(F.percentile("x", probs).alias("q")).collect()
    for r in ref:
        for p, q in zip(probs, r["q"]):
            assert abs(got[(r["g"], p)] - q) <= 1e-12 * (1 + abs(q)), (r["g"], p, got[(r["g"], p)], q)
