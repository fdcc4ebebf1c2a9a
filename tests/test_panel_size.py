"""A panel has the partitions its rows need, whatever the session's shuffle partitions; independent fits run side by side."""

import threading

import pytest
from candleframe.operators import ml as ML
from candleframe.operators import walkforward as WF
from candleframe.plans import catalog as C
from candleframe.plans import validation as V
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F


@pytest.fixture
def shuffles(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def hourly(spark, n=150):
    k = F.col("id")
    return spark.range(2 * n).select(
        F.when(k % 2 == 0, "a").otherwise("b").alias("symbol"), F.timestamp_seconds(F.floor(k / 2) * 3600).alias("ts"),
        *[(100 + 10 * F.sin(k * 0.7) + d).alias(c) for c, d in (("open", 0), ("high", 2), ("low", -2), ("close", 1))], (1000 + k % 17).cast("double").alias("volume"),
    )


def test_panel_and_forest_do_not_follow_the_shuffle_partitions(spark, shuffles):
    parts, forests = [], []
    for n in (5, 11):
        shuffles(n)
        p = ML.panel(hourly(spark), ["rsi_simple", "bb_pct"])
        parts.append(p.rdd.glom().collect())
        spec = ML.ModelSpec("RandomForest", lambda d: RandomForestClassifier(numTrees=5, seed=1))
        forests.append({(r.symbol, r.ts): r.prob_up for r in ML.bakeoff(p, ["rsi_simple", "bb_pct"], [spec])[0].collect()})
    assert len(parts[0]) == 1 and len(parts[0][0]) > 200 and parts[0] == parts[1]
    assert forests[0] == forests[1] and forests[0]


def test_sized_keeps_every_row_and_deals_them_out(spark):
    f = spark.range(1000).select((F.col("id") % 3).alias("symbol"), F.when(F.col("id") > 9, F.col("id")).alias("ts"), "id")
    out = ML.sized(f, part_rows=130)
    sizes = [len(p) for p in out.rdd.glom().collect()]
    assert len(sizes) == 8 and max(sizes) < 250 and sorted(r.id for r in out.collect()) == list(range(1000))
    assert ML.sized(f.limit(0)).count() == 0


def test_grid_panel_does_not_follow_the_shuffle_partitions(spark, shuffles, tmp_path, monkeypatch):
    k = F.col("id")
    spark.range(400).select(
        k.alias("event_id"), F.timestamp_seconds(k * 1800).alias("ts"), F.lit("a").alias("event_type"), (100 + 10 * F.sin(k * 0.7)).alias("value")
    ).write.parquet(f"{tmp_path}/events.parquet")
    seen, real = [], WF.tune_grid
    monkeypatch.setattr(WF, "tune_grid", lambda folded, cols: seen.append(folded.rdd.getNumPartitions()) or real(folded, cols, {"numTrees": [2], "maxDepth": [2], "minInstancesPerNode": [2]}))
    shuffles(7)
    assert V.q_tune_grid(spark, str(tmp_path)).count() == 4 and seen == [1]


def test_fits_run_side_by_side_in_order(spark):
    both = threading.Barrier(2, timeout=30)
    assert ML.side_by_side(spark, lambda x: (both.wait(), x * x)[1], [1, 2, 3, 4], 2) == [1, 4, 9, 16]
    assert ML.side_by_side(spark, lambda x: x, []) == []


def test_strategies_are_fitted_side_by_side(spark, tmp_path, monkeypatch):
    k = F.col("id")
    spark.range(400).select(
        k.alias("event_id"), F.timestamp_seconds(k * 1800).alias("ts"), F.lit("a").alias("event_type"), (100 + 10 * F.sin(k * 0.7)).alias("value")
    ).write.parquet(f"{tmp_path}/events.parquet")
    names, sets = set(), []

    def bakeoff(p, cols, specs):
        names.add(threading.current_thread().name)
        sets.append(tuple(cols))
        return p.select("symbol", "ts", F.lit(0.75).alias("prob_up")), {}

    monkeypatch.setattr(ML, "bakeoff", bakeoff)
    out = C.q_strategy_ml_merge(spark, str(tmp_path))
    assert sorted(sets) == sorted(map(tuple, C.FEATURE_SETS.values())) and threading.main_thread().name not in names
    assert {r.strategy for r in out.select("strategy").distinct().collect()} == set(C.FEATURE_SETS)
