"""Walk-forward validation: rolling-origin folds by time, and a full grid search over them.

The time from the first to the last row of the panel, all symbols together, is cut into
``splits + 1`` equal spans. Fold k (from 1) tests the rows of span k and trains on every row
whose label is known before span k begins: ``until`` names the time of the bar that the label
reads, so a row whose label looks into the test span is purged. A row is in several folds; it
is copied once for each (at most ``splits`` times), never joined.

``tune_grid`` fits every point of a grid in every fold. A fold is prepared once (assembled, and
scaled by its own train rows) and kept while its models are fitted side by side; all of its models
are scored in one pass over its test rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import Layout, windowed

# The corners of the reference's search ranges (trees, depth, least split).
FOREST_GRID = {"numTrees": (10, 100), "maxDepth": (3, 10), "minInstancesPerNode": (2, 10)}


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def label_until(f: DataFrame, bars_ahead: int = 1, out: str = "until", layout: Layout | None = None) -> DataFrame:
    """The time of the bar ``bars_ahead`` later in the series, from which a forward label is known; NULL at the end.

    ``f`` carries the layout columns (see ``series``)."""
    layout = layout or Layout()
    return windowed(f, layout, 0, [[(out, lambda w: F.lead(layout.ts, bars_ahead).over(w))]], ahead=bars_ahead)


def folds(f: DataFrame, splits: int = 3, ts: str = "ts", until: str | None = None) -> DataFrame:
    """``f`` with each row copied into its folds: ``fold`` (1 to ``splits``) and ``role`` (train, test).

    Rows without a time, and in train also rows whose label is never known, are in no fold."""
    if splits < 1:
        raise ValueError("walk-forward folds need at least one split")
    lo, hi = f.agg(F.min(_micros(F.col(ts))), F.max(_micros(F.col(ts)))).first()
    if lo is None:
        return f.withColumns({"fold": F.lit(1), "role": F.lit("train")}).limit(0)
    span = hi - lo + 1
    begins = [lo - (-k * span // (splits + 1)) for k in range(splits + 1)]  # first microsecond of each span
    now, known = _micros(F.col(ts)), _micros(F.col(until or ts))
    roles = [
        F.when((now >= begins[k]) & ((now < begins[k + 1]) if k < splits else F.lit(True)), F.struct(F.lit(k).alias("fold"), F.lit("test").alias("role")))
        .when(known < begins[k], F.struct(F.lit(k).alias("fold"), F.lit("train").alias("role")))
        for k in range(1, splits + 1)
    ]
    return f.withColumn("_in", F.explode(F.array_compact(F.array(*roles)))).select(*f.columns, "_in.fold", "_in.role")


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the grid's values, the last name turning fastest."""
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def tune_grid(
    folded: DataFrame,
    cols: Sequence[str],
    grid: Mapping[str, Sequence] | None = None,
    estimator: Estimator | None = None,
    label: str = "label",
    parallelism: int = 4,
) -> DataFrame:
    """One row for each grid point and fold, and one with ``fold`` 0 for the point's mean over its folds.

    Columns: trial, the grid's names, fold, n_train, n_test, accuracy, log_loss and rank (by the mean
    log loss; ties by trial). ``folded`` comes from ``folds``; a fold whose train rows hold one class
    only, or without test rows, can not be fitted and has no rows."""
    grid = dict(grid or FOREST_GRID)
    points = grid_points(grid)
    estimator = (estimator or RandomForestClassifier(seed=42)).copy().setFeaturesCol("features").setLabelCol(label)
    maps = [{estimator.getParam(k): v for k, v in p.items()} for p in points]
    spark = folded.sparkSession
    shape = folded.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"),
        F.countDistinct(F.when(F.col("role") == "train", F.col(label))).alias("classes"),
    )
    rows = []
    for r in shape.filter("n_test > 0 AND classes > 1").orderBy("fold").collect():  # one row for each fold
        part = folded.filter(F.col("fold") == r.fold).select(*cols, label, "role")
        prepare = Pipeline(stages=[
            VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="skip"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        ]).fit(part.filter("role = 'train'"))
        ready = prepare.transform(part).select("features", label, "role").persist(StorageLevel.MEMORY_AND_DISK)
        train, test = ready.filter("role = 'train'"), ready.filter("role = 'test'")
        fitted = estimator.fitMultiple(train, maps)
        with ThreadPool(min(parallelism, len(maps))) as pool:
            models = dict(pool.map(lambda _: next(fitted), maps))
        scored = None
        for trial, model in sorted(models.items()):
            one = model.transform(test).select(F.lit(trial).alias("trial"), F.col(label).alias("y"), "prediction", vector_to_array("probability")[1].alias("p"))
            scored = one if scored is None else scored.unionByName(one)
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
        metrics = scored.groupBy("trial").agg(
            F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"),
            F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("log_loss"),
        )
        rows += [(m.trial, r.fold, r.n_train, r.n_test, m.accuracy, m.log_loss) for m in metrics.collect()]  # one row for each point
        ready.unpersist()
    return _ranked(spark, rows, points, grid)


def _ranked(spark, rows: list, points: list[dict], grid: Mapping[str, Sequence]) -> DataFrame:
    """Fold rows with the points' values, their means, and the rank of each point."""
    kinds = {k: "double" if any(isinstance(v, float) for v in vs) else "boolean" if isinstance(vs[0], bool) else "string" if isinstance(vs[0], str) else "int" for k, vs in grid.items()}
    measured = spark.createDataFrame(rows, "trial int, fold int, n_train long, n_test long, accuracy double, log_loss double")
    table = spark.createDataFrame([(k, *p.values()) for k, p in enumerate(points)], "trial int, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))
    mean = measured.groupBy("trial").agg(
        F.lit(0).alias("fold"), F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"), F.avg("accuracy").alias("accuracy"), F.avg("log_loss").alias("log_loss"),
    )
    order = mean.select("trial", F.row_number().over(Window.orderBy("log_loss", "trial")).alias("rank"))  # one row for each point
    return measured.unionByName(mean).join(table, "trial").join(order, "trial").select("trial", *grid, "fold", "n_train", "n_test", "accuracy", "log_loss", "rank")
