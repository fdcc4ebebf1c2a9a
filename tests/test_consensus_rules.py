"""Consensus, merge and sentiment semantics on hand-made prediction rows."""

import datetime as dt

from pyspark.sql import functions as F

from candleframe.operators import consensus as CS

T0 = dt.datetime(2024, 1, 1)


def _preds(spark, rows):
    return spark.createDataFrame(
        [("S", T0, m, t, c, p, a, a) for m, t, c, p, a in rows],
        "symbol string, ts timestamp_ntz, model string, trend string, confidence double, prob_up double, accuracy double, f1 double",
    ).withColumn("signal", F.lit(0))


def test_vote_tie_broken_by_summed_confidence(spark):
    p = _preds(
        spark,
        [
            ("a", "weak_uptrend", 0.6, 0.6, 0.5),
            ("b", "weak_uptrend", 0.6, 0.6, 0.5),
            ("c", "weak_downtrend", 0.9, 0.4, 0.5),
            ("d", "weak_downtrend", 0.9, 0.4, 0.5),
            ("e", "sideways", 0.5, 0.5, 0.5),
        ],
    )
    r = CS.consensus_votes(p).collect()[0]
    assert r["trend"] == "weak_downtrend"
    assert abs(r["agreement"] - 0.4) < 1e-12 and r["agreement_level"] == "weak"
    assert abs(r["confidence"] - 0.9) < 1e-12


def test_full_tie_falls_back_to_trend_order(spark):
    p = _preds(spark, [("a", "sideways", 0.7, 0.5, 0.5), ("b", "strong_uptrend", 0.7, 0.8, 0.5)])
    assert CS.consensus_votes(p).collect()[0]["trend"] == "strong_uptrend"
    # mode: ties by trend name
    assert CS.consensus_mode(p).collect()[0]["trend"] == "sideways"


def test_weighted_consensus_cuts_are_strict(spark):
    p = _preds(spark, [("a", "weak_uptrend", 0.2, 0.6, 0.5), ("b", "sideways", 0.8, 0.5, 0.5)])
    r = CS.consensus_weighted(p).collect()[0]
    assert abs(r["score"] - 0.2) < 1e-12 and r["consensus"] == "sideways"  # 0.2 is not > 0.2


def test_distribution_always_has_five_trends(spark):
    p = _preds(spark, [("a", "weak_uptrend", 0.6, 0.6, 0.5)])
    r = CS.trend_distribution(p).collect()[0]
    assert r["weak_uptrend_votes"] == 1 and r["strong_downtrend_votes"] == 0
    assert r["strong_downtrend_confidence"] == 0.0 and r["dominant_trend"] == "weak_uptrend"


def test_rule_model_merge_truth_table(spark):
    rules = spark.createDataFrame(
        [
            ("S", T0, "r1", True, False),
            ("S", T0, "r2", False, True),
            ("S", T0, "r3", True, False),
            ("S", T0, "r4", False, False),
            ("S", T0, "r5", True, True),
            ("S", T0, "r6", True, False),
        ],
        "symbol string, ts timestamp_ntz, strategy string, bullish boolean, bearish boolean",
    )
    votes = spark.createDataFrame(
        [("S", T0, "r1", "bullish"), ("S", T0, "r2", "bearish"), ("S", T0, "r3", "bearish"), ("S", T0, "r4", "bearish")],
        "symbol string, ts timestamp_ntz, strategy string, prediction string",
    )
    got = {r["strategy"]: r["signal"] for r in CS.strategy_ml_merge(rules, votes).collect()}
    assert got == {
        "r1": "strong_bullish",
        "r2": "strong_bearish",
        "r3": "bullish",  # a bullish rule wins over a bearish model
        "r4": "bearish",
        "r5": "neutral",  # no model row, both rule sides -> neutral
        "r6": "bullish",  # no model row -> rule only
    }
    s = CS.sentiment(CS.strategy_ml_merge(rules, votes), 6).collect()[0]
    assert abs(s["sentiment_score"] - (2 - 2 + 1 - 1 + 0 + 1) / 12.0) < 1e-12
    assert s["overall_sentiment"] == "sideways"


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0, 5.0, 0.0],)], "logits array<double>")
    rows = CS.softmax_argmax(df, ["bearish", "neutral", "bullish"]).collect()
    assert rows[0]["label"] == "bullish" and abs(sum(rows[0]["probs"]) - 1) < 1e-12
    assert rows[1]["label"] == "bearish"  # first of tied maxima
