"""Predictions table and the consensus / decision operators over it.

``predictions`` is long, one row per (symbol, ts, model), from any source of that schema
(MLlib bake-off rows, rule strategies as voters), or wide, one row per (symbol, ts) with an
array ``votes`` of all its models. The rules' votes of a bar come from one row, so they are wide
from the start (``strategy_votes``) and a consensus needs no shuffle; long rows are gathered
into the same arrays by one aggregate per (symbol, ts), bounded by the model count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals as SG
from .series import BLK, BS, RN, Layout, windowed

# Trend labels in their natural order, their vote weights, and bucket cuts.
TRENDS = ["strong_uptrend", "weak_uptrend", "sideways", "weak_downtrend", "strong_downtrend"]
TREND_WEIGHTS = {"strong_uptrend": 2, "weak_uptrend": 1, "sideways": 0, "weak_downtrend": -1, "strong_downtrend": -2}
#: Default of ``strategy_predictions(hit_window=...)``: bars over which a rule's hit rate is taken.
HIT_WINDOW = 50

KEYS = ["symbol", "ts"]


def by_bar(preds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, votes): the votes of each bar in model order, from wide or long predictions.

    The order makes floating-point sums independent of how rows were partitioned."""
    if "votes" in preds.columns:
        return preds.select(*keys, "votes")
    own = [c for c in preds.columns if c not in keys and c != "model"]
    return preds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("model", *own))).alias("votes"))


def vote_sum(term: Callable[[Column], Column], votes: str = "votes") -> Column:
    """Sum of ``term`` over a bar's votes in model order, without nulls; 0 if there are none."""
    terms = F.transform(votes, lambda v: term(v).cast("double"))
    return F.aggregate(F.filter(terms, lambda x: x.isNotNull()), F.lit(0.0), lambda acc, x: acc + x)


def vote_count(which: Callable[[Column], Column], votes: str = "votes") -> Column:
    return F.size(F.filter(votes, which)).cast("long")


def vote_avg(term: Callable[[Column], Column], votes: str = "votes") -> Column:
    return F.try_divide(vote_sum(term, votes), vote_count(lambda v: term(v).isNotNull(), votes).cast("double"))


def trend_bucket(p: Column) -> Column:
    """Probability of an up move -> 5 trend labels (cuts .7 / .55 / .45 / .3)."""
    return (
        F.when(p > 0.7, "strong_uptrend")
        .when(p > 0.55, "weak_uptrend")
        .when(p < 0.3, "strong_downtrend")
        .when(p < 0.45, "weak_downtrend")
        .otherwise("sideways")
    )


def confidence_bucket(c: Column) -> Column:
    return F.when(c > 0.8, "high").when(c > 0.6, "medium").otherwise("low")


def agreement_level(share: Column) -> Column:
    return F.when(share >= 0.7, "strong").when(share >= 0.5, "moderate").otherwise("weak")


def trend_weight(trend: Column) -> Column:
    expr = F.lit(None).cast("int")
    for t, w in TREND_WEIGHTS.items():
        expr = F.when(trend == t, F.lit(w)).otherwise(expr)
    return expr


def strategy_predictions(wide: DataFrame, layout: Layout | None = None, hit_window: int = HIT_WINDOW) -> DataFrame:
    """``strategy_votes`` as long predictions, one row for each bar and rule."""
    return strategy_votes(wide, layout, hit_window).select(*KEYS, F.inline("votes"))


def strategy_votes(wide: DataFrame, layout: Layout | None = None, hit_window: int = HIT_WINDOW, carry: Sequence[str] = ()) -> DataFrame:
    """Rule strategies as voting models, all votes of a bar in its row, with the columns ``carry``.

    ``wide`` carries the bar layout (``_rn``, ``_blk``), ``delta_close`` and the 35
    ``sig_*`` columns. Per (symbol, model) series: a vote at t-1 is a hit when the close
    then moves in its direction (neutral votes are not scored); ``accuracy`` is the mean
    hit over the trailing ``hit_window`` bars (realised outcomes only). prob_up is that accuracy for a
    buy vote, its complement for a sell vote, 0.5 for neutral or unscored; a rule's hit
    rate stands for both accuracy and f1.
    """
    layout = layout or Layout()
    names = [n for n, _, _ in SG.STRATEGY_RULES]
    # One row per bar through the shuffle, 35 window columns.
    up = F.signum("delta_close").cast("int")
    levels = [
        [(f"_ps_{n}", (lambda n: lambda w: F.lag(f"sig_{n}", 1).over(w))(n)) for n in names],
        [
            (
                f"_hit_{n}",
                (
                    lambda n: lambda w: F.when(
                        F.col(f"_ps_{n}").isNull() | (F.col(f"_ps_{n}") == 0), F.lit(None).cast("double")
                    )
                    .when(up == F.col(f"_ps_{n}"), F.lit(1.0))
                    .otherwise(F.lit(0.0))
                )(n),
            )
            for n in names
        ],
        [(f"_acc_{n}", (lambda n: lambda w: F.avg(f"_hit_{n}").over(w.rowsBetween(-(hit_window - 1), 0)))(n)) for n in names],
    ]
    lay_cols = [c for c in (RN, BLK, BS) if c in wide.columns]
    wide_acc = windowed(wide.select(*KEYS, *lay_cols, "delta_close", *carry, *[f"sig_{n}" for n in names]), layout, hit_window + 1, levels)
    raw = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"sig_{n}").alias("signal"), F.col(f"_acc_{n}").alias("accuracy")) for n in sorted(names)])

    def vote(v: Column) -> Column:
        acc = F.coalesce(v["accuracy"], F.lit(0.5))
        up = F.when(v["signal"] == 1, acc).when(v["signal"] == -1, F.lit(1.0) - acc).otherwise(F.lit(0.5))
        return F.struct(
            v["model"].alias("model"), v["signal"].alias("signal"), up.alias("prob_up"), (F.lit(1.0) - up).alias("prob_down"),
            F.greatest(up, F.lit(1.0) - up).alias("confidence"), trend_bucket(up).alias("trend"), v["accuracy"].alias("accuracy"), v["accuracy"].alias("f1"),
        )

    return wide_acc.withColumn("_raw", raw).select(*KEYS, *carry, F.transform("_raw", vote).alias("votes"))


def ensemble_sign(preds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """sign of the vote sum, share of votes agreeing with it, mean confidence."""
    g = by_bar(preds, keys).select(
        *keys,
        F.aggregate(F.transform("votes", lambda v: v["signal"].cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0).cast("long"))).alias("_s"),
        F.size("votes").cast("long").alias("n_models"),
        vote_avg(lambda v: v["confidence"]).alias("mean_confidence"),
        vote_count(lambda v: v["signal"] == 1).alias("_up"),
        vote_count(lambda v: v["signal"] == 0).alias("_flat"),
        vote_count(lambda v: v["signal"] == -1).alias("_down"),
    )
    ens = F.signum(F.col("_s")).cast("int")
    agree = F.when(ens == 1, F.col("_up")).when(ens == -1, F.col("_down")).otherwise(F.col("_flat"))
    return g.select(
        *keys,
        ens.alias("ensemble_vote"),
        (agree / F.col("n_models")).alias("model_agreement"),
        "mean_confidence",
        F.when(ens == 1, "Uptrend").when(ens == -1, "Downtrend").otherwise("Sideways").alias("market_direction"),
    )


def consensus_weighted(preds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """sum(weight(trend) * confidence) / sum(confidence), labelled at +-0.2 and +-1 (strict)."""
    confidence = vote_sum(lambda v: v["confidence"])
    g = by_bar(preds, keys).select(*keys, F.try_divide(vote_sum(lambda v: trend_weight(v["trend"]) * v["confidence"]), confidence).alias("score"))
    s = F.col("score")
    label = (
        F.when(s > 1, "strong_uptrend")
        .when(s > 0.2, "weak_uptrend")
        .when(s < -1, "strong_downtrend")
        .when(s < -0.2, "weak_downtrend")
        .otherwise("sideways")
    )
    return g.select(*keys, "score", label.alias("consensus"))


def trend_distribution(preds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per trend (all 5 always present, as columns): votes, share, mean confidence (0 if
    none), names of the models; trends that have votes, ranked by (votes, mean confidence)
    desc, then trend order; the first of them; votes for other labels."""
    said = lambda t: lambda v: F.when(v["trend"] == t, v["confidence"])
    g = by_bar(preds, keys).select(
        *keys,
        F.size("votes").cast("long").alias("n_models"),
        *[vote_count((lambda t: lambda v: v["trend"] == t)(t)).alias(f"{t}_votes") for t in TRENDS],
        *[F.coalesce(vote_avg(said(t)), F.lit(0.0)).alias(f"{t}_confidence") for t in TRENDS],
        *[vote_sum(said(t)).alias(f"_{t}_sum") for t in TRENDS],
        *[F.array_join(F.transform(F.filter("votes", (lambda t: lambda v: v["trend"] == t)(t)), lambda v: v["model"]), ",").alias(f"{t}_models") for t in TRENDS],
    )
    # Rank the 5 candidates with one array sort per row (fixed size 5).
    cand = F.array(
        *[
            F.struct(
                F.col(f"{t}_votes").alias("votes"),
                F.col(f"{t}_confidence").alias("conf"),
                F.col(f"_{t}_sum").alias("sum_conf"),
                F.lit(-i).alias("order"),
                F.lit(t).alias("trend"),
            )
            for i, t in enumerate(TRENDS)
        ]
    )
    return g.withColumn("_c", cand).select(
        *keys,
        "n_models",
        *[c for t in TRENDS for c in (f"{t}_votes", f"{t}_confidence", f"{t}_models")],
        (F.col("n_models") - sum((F.col(f"{t}_votes") for t in TRENDS), F.lit(0))).alias("other_votes"),
        F.array_join(
            F.transform(
                F.sort_array(F.transform(F.filter("_c", lambda x: x["votes"] > 0), lambda x: F.struct(x["votes"], x["conf"], x["order"], x["trend"])), asc=False),
                lambda x: x["trend"],
            ),
            ",",
        ).alias("ranked_trends"),
        *[(F.col(f"{t}_votes") / F.col("n_models") * 100.0).alias(f"{t}_pct") for t in TRENDS],
        F.array_max(F.transform("_c", lambda x: F.struct(x["votes"], x["conf"], x["order"], x["trend"])))["trend"].alias("dominant_trend"),
        F.array_max(F.transform("_c", lambda x: F.struct(x["votes"], x["sum_conf"], x["order"], x["trend"])))["trend"].alias("vote_winner"),
        F.array_max(F.transform("_c", lambda x: x["conf"])).alias("highest_confidence"),
    )


def consensus_votes(preds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Most votes wins; ties -> larger summed confidence -> trend order. Agreement share
    and level, mean confidence of the winner."""
    d = trend_distribution(preds, keys)
    votes = F.col("_w_votes")
    out = d.withColumn(
        "_w_votes", F.coalesce(*[F.when(F.col("vote_winner") == t, F.col(f"{t}_votes")) for t in TRENDS])
    ).withColumn("_w_conf", F.coalesce(*[F.when(F.col("vote_winner") == t, F.col(f"{t}_confidence")) for t in TRENDS]))
    share = votes / F.col("n_models")
    return out.select(
        *keys,
        F.col("vote_winner").alias("trend"),
        F.col("_w_conf").alias("confidence"),
        share.alias("agreement"),
        agreement_level(share).alias("agreement_level"),
        "other_votes",
    )


def consensus_mode(preds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Most frequent trend (ties broken by trend name), mean confidence and mean prob_up."""
    trends = F.filter(F.transform("votes", lambda v: v["trend"]), lambda t: t.isNotNull())
    g = by_bar(preds, keys).withColumn("_t", trends)
    tally = F.transform(F.array_distinct("_t"), lambda t: F.struct((-F.size(F.filter("_t", lambda x: x == t))).alias("n"), t.alias("trend")))
    return g.select(*keys, F.array_min(tally)["trend"].alias("trend"), vote_avg(lambda v: v["confidence"]).alias("mean_confidence"), vote_avg(lambda v: v["prob_up"]).alias("mean_prob_up"))


def ensemble_prob(preds: DataFrame, weights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """sum(p_up * w * perf) / sum(w * perf), perf = (accuracy + f1) / 2, over models that
    have a weight (inner join with the weight table, normalised to sum 1)."""
    rows = weights.select("model", "weight").collect()  # one row per model
    total = sum(r.weight for r in rows)
    table = F.create_map(*[F.lit(x) for r in rows for x in (r.model, r.weight / total)]) if rows else F.lit(None).cast("map<string,double>")
    bars = by_bar(preds, keys).withColumn("_w", table)
    bars = bars.withColumn("votes", F.filter("votes", lambda v: F.col("_w")[v["model"]].isNotNull())).filter(F.size("votes") > 0)

    def share(v: Column) -> Column:
        return F.col("_w")[v["model"]] * (F.coalesce(v["accuracy"], F.lit(0.0)) + F.coalesce(v["f1"], F.lit(0.0))) / 2.0

    g = bars.select(*keys, vote_sum(lambda v: v["prob_up"] * share(v)).alias("_num"), vote_sum(share).alias("_den"))
    p = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(F.lit(0.0))
    return g.select(*keys, p.alias("up_probability"), (F.lit(1.0) - p).alias("down_probability"))


def decision(ens: DataFrame, context: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """STRONG_BUY..STRONG_SELL from the ensemble up-probability and market context.

    confidence = |up - down| (0..1); thresholds 0.65 / 0.55 lowered by min(0.05, volatility);
    confirmations: recent_trend, rsi extreme, volume_confirmed. ``context`` carries
    (keys, volatility, recent_trend, rsi_signal, volume_confirmed)."""
    j = ens.join(context, list(keys), "inner")
    up, down = F.col("up_probability"), F.col("down_probability")
    conf = F.abs(up - down)
    adj = F.least(F.lit(0.05), F.coalesce(F.col("volatility"), F.lit(0.0)))
    strong, moderate = F.lit(0.65) - adj, F.lit(0.55) - adj
    up_conf = (F.col("recent_trend") == "up") | (F.col("rsi_signal") == "up")
    dn_conf = (F.col("recent_trend") == "down") | (F.col("rsi_signal") == "down")
    vol_ok = F.coalesce(F.col("volume_confirmed"), F.lit(False))
    dec = (
        F.when((conf >= strong) & (up > down), F.when(F.coalesce(up_conf, F.lit(False)) & vol_ok, "STRONG_BUY").otherwise("BUY"))
        .when(conf >= strong, F.when(F.coalesce(dn_conf, F.lit(False)) & vol_ok, "STRONG_SELL").otherwise("SELL"))
        .when((conf >= moderate) & (up > down), F.when(F.coalesce(up_conf, F.lit(False)), "BUY").otherwise("HOLD"))
        .when(conf >= moderate, F.when(F.coalesce(dn_conf, F.lit(False)), "SELL").otherwise("HOLD"))
        .otherwise("HOLD")
    )
    return j.select(*keys, "up_probability", "down_probability", conf.alias("confidence_level"), dec.alias("decision"))


def up_down_label(preds: DataFrame) -> DataFrame:
    p = F.coalesce(F.col("prob_up"), F.lit(0.0))
    return preds.withColumn("prediction", F.when(p > 0.5, "UP").otherwise("DOWN"))


# ---------------------------------------------------------------------------
# Rule x model merge for the paired strategies, sentiment over the merged signals

SIGNAL_WEIGHTS = {"strong_bullish": 2, "bullish": 1, "neutral": 0, "bearish": -1, "strong_bearish": -2}


def strategy_ml_merge(rules: DataFrame, model_votes: DataFrame | None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rule signal x model vote per (keys, strategy). ``rules``: keys, strategy, bullish,
    bearish. ``model_votes``: keys, strategy, prediction ('bullish'/'bearish'), confidence,
    prob_up. A rule without a model row keeps its rule-only signal (left outer join).
    Both sides are partitioned on the same keys, so the join adds no skew of its own."""
    if model_votes is None:
        j = rules.withColumn("prediction", F.lit(None).cast("string"))
    else:
        j = rules.join(model_votes, [*keys, "strategy"], "left")
    bull, bear, pred = F.col("bullish"), F.col("bearish"), F.col("prediction")
    has_model = pred.isNotNull()
    with_model = (
        F.when(bull & (pred == "bullish"), "strong_bullish")
        .when(bear & (pred == "bearish"), "strong_bearish")
        .when(bull | (pred == "bullish"), "bullish")
        .when(bear | (pred == "bearish"), "bearish")
        .otherwise("neutral")
    )
    rule_only = F.when(bull & ~bear, "bullish").when(bear & ~bull, "bearish").otherwise("neutral")
    return j.withColumn("signal", F.when(has_model, with_model).otherwise(rule_only))


def sentiment(merged: DataFrame, n_strategies: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """score = sum(weight) / (2 * n strategies); label at +-0.2 / +-0.6 (strict); counts."""
    w = F.lit(0)
    for s, v in SIGNAL_WEIGHTS.items():
        w = F.when(F.col("signal") == s, F.lit(v)).otherwise(w)
    g = merged.groupBy(*keys).agg(
        (F.sum(w) / float(2 * n_strategies)).alias("sentiment_score"),
        *[F.count_if(F.col("signal") == s).alias(f"n_{s}") for s in SIGNAL_WEIGHTS],
    )
    sc = F.col("sentiment_score")
    label = (
        F.when(sc > 0.6, "strong_uptrend")
        .when(sc > 0.2, "uptrend")
        .when(sc < -0.6, "strong_downtrend")
        .when(sc < -0.2, "downtrend")
        .otherwise("sideways")
    )
    return g.withColumn("overall_sentiment", label)


def rank_models(preds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rank of each model per (keys) by (accuracy + f1)/2 desc, then accuracy desc, then model name."""

    def place(v: Column) -> Column:
        perf = (F.coalesce(v["accuracy"], F.lit(0.0)) + F.coalesce(v["f1"], F.lit(0.0))) / 2.0
        return F.struct((-perf).alias("p"), F.coalesce(-v["accuracy"], F.lit(float("inf"))).alias("a"), v["model"].alias("m"), v.alias("v"))

    g = by_bar(preds, keys).select(*keys, F.posexplode(F.array_sort(F.transform("votes", place))).alias("_k", "_r"))
    return g.select(*keys, "_r.v.*", (-F.col("_r.p")).alias("performance"), (F.col("_k") + 1).alias("rank"))


def top_k_per_trend(preds: DataFrame, k: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """The k votes of highest confidence for each trend of a bar, ties by model name."""

    def best(t: Column) -> Column:
        own = F.filter("votes", lambda v: v["trend"].eqNullSafe(t))
        placed = F.array_sort(F.transform(own, lambda v: F.struct(F.coalesce(-v["confidence"], F.lit(float("inf"))).alias("c"), v["model"].alias("m"), v.alias("v"))))
        return F.transform(F.slice(placed, 1, k), lambda x, i: F.struct(x["v"].alias("v"), (i + 1).alias("trend_rank")))

    trends = F.array_distinct(F.transform("votes", lambda v: v["trend"]))
    g = by_bar(preds, keys).select(*keys, F.explode(F.flatten(F.transform(trends, best))).alias("_r"))
    return g.select(*keys, "_r.v.*", "_r.trend_rank")


def directions(n: int) -> list[str]:
    """The labels of a model with ``n`` logits."""
    # Label names of models with 3 and 5 logits.
    known = {
        3: ["uptrend", "sideways", "downtrend"],
        5: ["strong_uptrend", "weak_uptrend", "sideways", "weak_downtrend", "strong_downtrend"],
    }
    return known.get(n) or [f"class_{k}" for k in range(n)]


def softmax_argmax(logits: DataFrame, labels: Sequence[str], col: str = "logits") -> DataFrame:
    """Softmax over a logits array of any length (max-shifted), best label and its probability;
    a class beyond ``labels`` takes the label of class 0."""
    x = F.col(col)
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    tot = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    probs = F.transform(e, lambda v: v / tot)
    best = F.array_position(probs, F.array_max(probs)) - 1
    lab = F.array(*[F.lit(s) for s in labels])
    return logits.withColumn("probs", probs).withColumn("label", F.coalesce(F.get(lab, best.cast("int")), F.get(lab, F.lit(0)))).withColumn(
        "label_confidence", F.array_max(F.col("probs"))
    )
