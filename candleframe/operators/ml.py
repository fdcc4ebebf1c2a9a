"""MLlib model bake-off over one panel feature table.

Models are fit once on the train rows of all symbols (not one model per symbol), scored
on the test rows, and returned as long ``predictions`` rows. The panel is checkpointed to
the session's checkpoint folder first: every fit re-reads it, and lineage is cut so lost
executors recompute from the checkpoint, not from the raw ticks.

A fit is hundreds of short jobs in a row, each over every partition, and a tree level shuffles
one histogram for each node and partition. The panel therefore has as many partitions as its
rows need (``sized``), whatever ``spark.sql.shuffle.partitions`` says, and models that do not
depend on each other are fit side by side (``side_by_side``).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indicators import features
from ..session import ensure_checkpoint_dir
from .labels import forward_labels, split_chrono
from .series import Layout, drop_layout

# The 12-feature list of the reference's prediction path
# (stoch = stoch_k, stoch_signal = stoch_d).
FEATURES_12 = [
    "rsi", "mfi", "adx", "cci", "williams_r", "bb_pct", "atr", "force_index", "stoch_k", "stoch_d", "volume_sma", "volatility",
]

# The reference's per-model ensemble weights (normalised when used).
MODEL_WEIGHTS: list[tuple[str, float]] = [
    ("XGBoost", 0.12), ("LightGBM", 0.12), ("CatBoost", 0.12), ("GradientBoosting", 0.10),
    ("RandomForest", 0.08), ("ExtraTrees", 0.08), ("VotingEnsemble", 0.08), ("StackingEnsemble", 0.08),
    ("LSTM", 0.06), ("Prophet", 0.06), ("GARCH", 0.06),
    ("AdaBoost", 0.02), ("Bagging", 0.02), ("KNeighbors", 0.02), ("MLP", 0.02), ("SVC", 0.02),
    ("LogisticRegression", 0.02), ("DecisionTree", 0.02), ("RidgeClassifier", 0.02), ("ElasticNet", 0.02),
    ("IsolationForest", 0.02), ("QuadraticDA", 0.02), ("LinearDA", 0.02), ("HistGradientBoosting", 0.02),
    ("GaussianNB", 0.02),
]


@dataclass(frozen=True)
class ModelSpec:
    name: str
    make: Callable[[int], object]  # n_features -> estimator
    has_probability: bool = True
    ridge: bool = False


def default_models() -> list[ModelSpec]:
    lbl = "label"
    return [
        ModelSpec("RandomForest", lambda d: RandomForestClassifier(labelCol=lbl, numTrees=50, maxDepth=5, seed=42)),
        ModelSpec("GradientBoosting", lambda d: GBTClassifier(labelCol=lbl, maxIter=30, maxDepth=3, stepSize=0.1, seed=42)),
        ModelSpec("XGBoost", lambda d: GBTClassifier(labelCol=lbl, maxIter=50, maxDepth=5, stepSize=0.1, seed=7)),
        ModelSpec("DecisionTree", lambda d: DecisionTreeClassifier(labelCol=lbl, maxDepth=10, seed=42)),
        ModelSpec(
            "Bagging",
            lambda d: RandomForestClassifier(labelCol=lbl, numTrees=30, featureSubsetStrategy="all", bootstrap=True, seed=42),
        ),
        ModelSpec("LogisticRegression", lambda d: LogisticRegression(labelCol=lbl, maxIter=100)),
        ModelSpec("ElasticNet", lambda d: LogisticRegression(labelCol=lbl, maxIter=100, regParam=0.001, elasticNetParam=0.5)),
        ModelSpec("GaussianNB", lambda d: NaiveBayes(labelCol=lbl, modelType="gaussian")),
        ModelSpec("SVC", lambda d: LinearSVC(labelCol=lbl, maxIter=50), has_probability=False),
        ModelSpec("MLP", lambda d: MultilayerPerceptronClassifier(labelCol=lbl, layers=[d, 32, 2], maxIter=100, seed=42)),
        ModelSpec("RidgeClassifier", lambda d: LinearRegression(labelCol="_pm", regParam=1.0), has_probability=False, ridge=True),
    ]


# Rows of a panel in one partition, and models fit at a time.
PART_ROWS = 65_536
PARALLELISM = 4


def sized(f: DataFrame, keys: Sequence[str] = ("symbol", "ts"), part_rows: int = PART_ROWS) -> DataFrame:
    """``f`` checkpointed with one partition for each ``part_rows`` rows, dealt and sorted by ``keys``.

    Seeded samples (a forest's bootstrap) follow the place of a row, so with unique keys they depend
    on the rows alone, not on the session's shuffle partitions."""
    ensure_checkpoint_dir(f.sparkSession)
    kept = f.persist(StorageLevel.MEMORY_AND_DISK)
    parts = max(1, -(-kept.count() // part_rows))
    out = kept.repartition(parts, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    kept.unpersist()
    return out


def side_by_side(spark: SparkSession, task: Callable, items: Sequence, parallelism: int = PARALLELISM) -> list:
    """``task`` of every item, in the order of the items; ``parallelism`` of them run at a time."""
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(task), items, chunksize=1)


def panel(bars: DataFrame, cols: Sequence[str] = FEATURES_12, label: str = "label_up_1", layout: Layout | None = None) -> DataFrame:
    """Feature panel: indicators + forward label + chronological split, rows with any
    NULL feature or label dropped (warm-up and the last bars), checkpointed by size."""
    layout = layout or Layout()
    f = forward_labels(features(bars, [*cols, "returns"], layout), layout)
    f = split_chrono(f)
    extra = [c for c in ("close", "next_return") if c not in cols]
    f = drop_layout(f).select("symbol", "ts", *cols, F.col(label).cast("double").alias("label"), "is_test", *extra)
    return sized(f.na.drop(subset=[*cols, "label"]))


def _prep(cols: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def bakeoff(p: DataFrame, cols: Sequence[str] = FEATURES_12, models: Sequence[ModelSpec] | None = None):
    """Fit every model on train rows; return (predictions on test rows, fitted pipelines).
    A model that cannot be fit on the data (say, one class only) yields no rows and a
    warning; any other error, such as a lost executor, rises. ``has_probability`` tells
    which rows carry a probability of the model, for the soft vote."""
    models = list(models or default_models())
    train = p.filter(~F.col("is_test")).withColumn("_pm", F.col("label") * 2.0 - 1.0)
    test = p.filter(F.col("is_test"))

    def fit(spec: ModelSpec):
        try:
            return Pipeline(stages=[*_prep(cols), spec.make(len(cols))]).fit(train)
        except IllegalArgumentException as e:  # this model cannot be fit on these data; other errors rise
            return e

    outs, fitted = [], {}
    for spec, pipe in zip(models, side_by_side(p.sparkSession, fit, models), strict=True):
        if isinstance(pipe, IllegalArgumentException):
            warnings.warn(f"{spec.name} was not fit: {pipe}", stacklevel=2)
            continue
        fitted[spec.name] = pipe
        scored = pipe.transform(test)
        if spec.ridge:
            prob = F.lit(0.5)
            pred = (F.col("prediction") > 0).cast("double")
        elif spec.has_probability:
            prob = vector_to_array("probability")[1]
            pred = F.col("prediction")
        else:
            prob = F.lit(0.5)
            pred = F.col("prediction")
        outs.append(
            scored.select(
                "symbol", "ts", F.lit(spec.name).alias("model"), prob.alias("prob_up"), pred.alias("prediction"), "label",
                F.lit(spec.has_probability and not spec.ridge).alias("has_probability"),
            )
        )
    if not outs:
        raise RuntimeError("no model could be fit on this panel")
    preds = outs[0]
    for o in outs[1:]:
        preds = preds.unionByName(o)
    return preds, fitted


def eval_metrics(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """accuracy, precision, recall, f1 (positive class 1) and weighted f1 from confusion
    counts; 0 where undefined."""
    y, yh = F.col("label"), F.col("prediction")
    g = preds.groupBy(*by).agg(
        F.count_if((y == 1) & (yh == 1)).alias("tp"),
        F.count_if((y == 0) & (yh == 1)).alias("fp"),
        F.count_if((y == 1) & (yh == 0)).alias("fn"),
        F.count_if((y == 0) & (yh == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def z(x):
        return F.coalesce(x, F.lit(0.0))

    prec = z(F.try_divide(tp, tp + fp))
    rec = z(F.try_divide(tp, tp + fn))
    f1 = z(F.try_divide(2.0 * prec * rec, prec + rec))
    prec0 = z(F.try_divide(tn, tn + fn))
    rec0 = z(F.try_divide(tn, tn + fp))
    f10 = z(F.try_divide(2.0 * prec0 * rec0, prec0 + rec0))
    return g.select(
        *by,
        z(F.try_divide(tp + tn, n)).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        f1.alias("f1"),
        z(F.try_divide(f1 * (tp + fn) + f10 * (tn + fp), n)).alias("f1_weighted"),
        n.cast("long").alias("n_test"),
    )


def feature_importance(spark, fitted: dict, cols: Sequence[str]) -> DataFrame:
    """Per tree model, importance of each named feature (rows)."""
    rows = []
    for name, pipe in fitted.items():
        m = pipe.stages[-1]
        if hasattr(m, "featureImportances"):
            imp = m.featureImportances.toArray().tolist()
            rows += [(name, c, float(v)) for c, v in zip(cols, imp)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def top_importance(imp: DataFrame, k: int = 20) -> DataFrame:
    """Mean importance over models, top k (a top-k report: the limit is the feature)."""
    return imp.groupBy("feature").agg(F.avg("importance").alias("mean_importance")).orderBy(
        F.col("mean_importance").desc(), F.col("feature")
    ).limit(k)


def voting(preds: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Soft vote (mean prob_up of models with a probability) and hard vote (majority)."""
    return preds.groupBy(*keys).agg(
        F.avg(F.when(F.col("has_probability"), F.col("prob_up"))).alias("soft_prob_up"),
        (F.avg("prediction") > 0.5).cast("int").alias("hard_vote"),
        F.count(F.lit(1)).alias("n_models"),
    )


def with_eval(preds: DataFrame) -> DataFrame:
    """Attach each model's test accuracy / f1 to its prediction rows (predictions table)."""
    m = eval_metrics(preds).select("model", "accuracy", "f1")
    return preds.join(F.broadcast(m), "model", "left")  # one row per model


def weights_table(spark) -> DataFrame:
    return spark.createDataFrame(MODEL_WEIGHTS, "model string, weight double")


def tune_random_search(p: DataFrame, cols: Sequence[str] = FEATURES_12, trials: int = 10, seed: int = 42) -> DataFrame:
    """Random search over RF hyper-parameters (trees 10-100, depth 3-10, min instances
    2-10) with a train/validation split inside the train rows; returns every trial's
    validation AUC, best first."""
    import random

    rng = random.Random(seed)
    rf = RandomForestClassifier(labelCol="label", seed=seed)
    grid = []
    for _ in range(trials):
        grid.append({rf.numTrees: rng.randint(10, 100), rf.maxDepth: rng.randint(3, 10), rf.minInstancesPerNode: rng.randint(2, 10)})
    tvs = TrainValidationSplit(
        estimator=Pipeline(stages=[*_prep(cols), rf]),
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol="label"),
        trainRatio=0.8,
        parallelism=4,
        seed=seed,
    )
    model = tvs.fit(p.filter(~F.col("is_test")))
    rows = [
        (int(g[rf.numTrees]), int(g[rf.maxDepth]), int(g[rf.minInstancesPerNode]), float(m))
        for g, m in zip(grid, model.validationMetrics)
    ]
    df = p.sparkSession.createDataFrame(rows, "num_trees int, max_depth int, min_instances int, val_auc double")
    return df.orderBy(F.col("val_auc").desc())


def regress_next_return(p: DataFrame, cols: Sequence[str] = FEATURES_12) -> DataFrame:
    """RF and GBT regressors of the next-bar return; test RMSE and MAE per model."""
    data = p.filter(F.col("next_return").isNotNull())
    models = (
        ("RandomForestRegressor", RandomForestRegressor(labelCol="next_return", numTrees=50, maxDepth=5, seed=42)),
        ("GBTRegressor", GBTRegressor(labelCol="next_return", maxIter=30, maxDepth=3, seed=42)),
    )
    fits = side_by_side(p.sparkSession, lambda m: Pipeline(stages=[*_prep(cols), m[1]]).fit(data.filter(~F.col("is_test"))), models)
    out = []
    for (name, _), m in zip(models, fits, strict=True):
        s = m.transform(data.filter(F.col("is_test")))
        out.append(
            s.agg(
                F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("next_return"), 2))).alias("rmse"),
                F.avg(F.abs(F.col("prediction") - F.col("next_return"))).alias("mae"),
                F.count(F.lit(1)).alias("n_test"),
            ).select(F.lit(name).alias("model"), "*")
        )
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------------------
# Gaussian discriminants: sufficient statistics by one aggregate pass, d x d algebra on
# the driver (the statistics are O(d^2), independent of the row count), scoring as a
# Spark column expression.


def _class_stats(train: DataFrame, cols: Sequence[str]):
    d = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    rows = train.groupBy("label").agg(*aggs).collect()  # two rows of O(d^2) numbers
    import numpy as np

    stats = {}
    for r in rows:
        n = float(r["n"])
        mu = np.array([r[f"s{i}"] / n for i in range(d)])
        m2 = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                m2[i, j] = m2[j, i] = r[f"p{i}_{j}"] / n
        cov = (m2 - np.outer(mu, mu)) * n / max(n - 1.0, 1.0)
        stats[int(r["label"])] = (n, mu, cov)
    return stats


def _quadratic_score(cols, mu, inv, const):
    """const - 0.5 (x - mu)' inv (x - mu) as a Column."""
    d = len(cols)
    dev = [F.col(c) - float(mu[i]) for i, c in enumerate(cols)]
    q = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            if inv[i, j] != 0.0:
                q = q + float(inv[i, j]) * dev[i] * dev[j]
    return F.lit(float(const)) - 0.5 * q


def discriminant(p: DataFrame, cols: Sequence[str] = FEATURES_12, quadratic: bool = True, reg: float = 0.1) -> DataFrame:
    """LDA (pooled covariance) or QDA (per-class covariance), both regularised as
    (1 - reg) * cov + reg * I on standardised features; returns prediction rows."""
    import numpy as np

    train = p.filter(~F.col("is_test"))
    mom = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).collect()[0]
    z = {c: (F.col(c) - float(mom[f"m_{c}"])) / float(mom[f"s_{c}"] or 1.0) for c in cols}
    zcols = [f"_z_{c}" for c in cols]
    zp = p.withColumns({f"_z_{c}": z[c] for c in cols})
    st = _class_stats(zp.filter(~F.col("is_test")), zcols)
    total = sum(v[0] for v in st.values())
    eye = np.eye(len(cols))
    if not quadratic:
        pooled = sum((v[0] - 1) * v[2] for v in st.values()) / max(total - len(st), 1.0)
        pooled = (1 - reg) * pooled + reg * eye
    scores = {}
    for k, (n, mu, cov) in st.items():
        c = (1 - reg) * cov + reg * eye if quadratic else pooled
        inv = np.linalg.inv(c)
        const = np.log(n / total) - 0.5 * np.linalg.slogdet(c)[1]
        scores[k] = _quadratic_score(zcols, mu, inv, const)
    s1, s0 = scores.get(1, F.lit(-1e300)), scores.get(0, F.lit(-1e300))
    prob = 1.0 / (1.0 + F.exp(F.greatest(F.least(s0 - s1, F.lit(700.0)), F.lit(-700.0))))
    name = "QuadraticDA" if quadratic else "LinearDA"
    test = zp.filter(F.col("is_test"))
    return test.select(
        "symbol", "ts", F.lit(name).alias("model"), prob.alias("prob_up"), (prob > 0.5).cast("double").alias("prediction"), "label",
        F.lit(True).alias("has_probability"),
    )


# ---------------------------------------------------------------------------
# Stacking with chronological out-of-sample base predictions


def stacking(p: DataFrame, cols: Sequence[str] = FEATURES_12, base: Sequence[str] = ("RandomForest", "GradientBoosting", "LogisticRegression"), holdout: float = 0.3) -> DataFrame:
    """Meta logistic regression over base-model probabilities without look-ahead:
    base models fit on the first (1 - holdout) of each symbol's train time span score the
    rest of it; the meta-model learns from those scores; base models refit on all
    train rows then score the test rows for the meta-model. Returns prediction rows
    (model = 'StackingEnsemble')."""
    from .joins import join_small

    specs = [m for m in default_models() if m.name in base]
    train = p.filter(~F.col("is_test"))
    # chronological cut inside each symbol's train span: a time cut from a per-symbol
    # min/max aggregate (no window over a whole symbol)
    span = train.groupBy("symbol").agg(F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    secs = F.unix_micros(F.col("_t1").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))
    cut = span.select("symbol", (F.unix_micros(F.col("_t0").cast("timestamp")) + (secs * (1.0 - holdout)).cast("long")).alias("_cut"))
    r = join_small(train, cut, "symbol").withColumn("_late", F.unix_micros(F.col("ts").cast("timestamp")) >= F.col("_cut"))
    halves = sized(r.filter(F.col("_late").isNotNull()).withColumn("is_test", F.col("_late")).drop("_late", "_cut"))
    level0, _ = bakeoff(halves, cols, specs)
    meta_cols = [f"_p_{m.name}" for m in specs]

    def wide(preds: DataFrame) -> DataFrame:
        return preds.groupBy("symbol", "ts", "label").pivot("model", [m.name for m in specs]).agg(F.first("prob_up")).toDF(
            "symbol", "ts", "label", *meta_cols
        )

    meta_train = wide(level0).na.drop()
    meta = Pipeline(stages=[VectorAssembler(inputCols=meta_cols, outputCol="features"), LogisticRegression(labelCol="label")]).fit(
        meta_train
    )
    level1, _ = bakeoff(p, cols, specs)
    scored = meta.transform(wide(level1).na.drop())
    return scored.select(
        "symbol",
        "ts",
        F.lit("StackingEnsemble").alias("model"),
        vector_to_array("probability")[1].alias("prob_up"),
        F.col("prediction"),
        "label",
    )
