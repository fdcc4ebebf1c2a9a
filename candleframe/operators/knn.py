"""Exact k nearest neighbours without all pairs: a k-d partition of the train rows with bounding boxes.

A k-d tree over a bounded sample of the train rows cuts the space into leaves; every train row is
dealt to its leaf, and each leaf keeps the box its rows really span. A test row first visits the leaf
with the nearest box. Its k-th distance there bounds its search: of the other leaves it visits those
whose box is not farther, and no others, which loses no neighbour. Leaves travel in blocks of at
most about ``LEAF_ROWS`` train rows by ``VISITS`` test rows, so neither a leaf of many equal rows nor one that
all test rows visit meets one task whole. The tree and the boxes are bounded (``DEPTH``).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Train rows and test rows of one block, about; levels of the tree and rows of its sample, at most.
LEAF_ROWS, VISITS, DEPTH, SAMPLE = 2048, 4096, 10, 1 << 16


def grow(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and cut of the inner nodes of a complete binary tree, node n's children at 2n+1 and 2n+2."""
    dims, cuts = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    parts = {0: points}
    for n in range(len(dims)):
        own = parts.pop(n)
        if len(own):
            dims[n] = int(np.ptp(own, axis=0).argmax())
            cuts[n] = float(np.median(own[:, dims[n]]))
        right = own[:, dims[n]] > cuts[n]
        parts[2 * n + 1], parts[2 * n + 2] = own[~right], own[right]
    return dims, cuts


def leaf_of(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node = np.zeros(len(x), dtype=np.int64)
    while len(dims) and len(node) and node[0] < len(dims):
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cuts[node])
    return node - len(dims)


def box_distance(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each box."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - x[:, None, j], x[:, None, j] - high[None, :, j]), 0.0)
        out += gap * gap
    return out


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _nearest(k: int):
    def run(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(train) and len(test):
            x, ids, labels = _stack(train["x"]), train["id"].to_numpy(), train["label"].to_numpy()
            q, own = _stack(test["q"]), test["test"].to_numpy()
            for s in range(0, len(q), 64):
                d2 = ((q[s : s + 64, None, :] - x[None, :, :]) ** 2).sum(axis=2)
                for r, row in enumerate(d2):
                    best = np.lexsort((ids, row))[:k]
                    out.append(pd.DataFrame({"test": own[s + r], "id": ids[best], "label": labels[best], "d2": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({"test": [], "id": [], "label": [], "d2": []})

    return run


def _visit(train: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """(test, id, label, d2): the k nearest of each test row in each block that it visits."""
    chunks = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("chunks"))
    blocks = train.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF_ROWS).cast("int").alias("blocks"))
    size = chunks.join(blocks, "leaf")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = train.join(size, "leaf").withColumn("block", own("id", "blocks")).withColumn("chunk", every("chunks")).select("leaf", "block", "chunk", "id", "x", "label")
    v = visits.join(size, "leaf").withColumn("chunk", own("test", "chunks")).withColumn("block", every("blocks"))
    v = v.select(F.col("leaf").alias("to_leaf"), F.col("block").alias("to_block"), F.col("chunk").alias("to_chunk"), "test", F.col("x").alias("q"))
    return t.groupBy("leaf", "block", "chunk").cogroup(v.groupBy("to_leaf", "to_block", "to_chunk")).applyInPandas(_nearest(k), "test long, id long, label double, d2 double")


def nearest(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """(test, id, label, d2): the k train rows nearest to each test row, ties to the smaller id.

    ``train`` holds id (long, unique), x (array of finite doubles) and label (double), ``test`` holds id and x.
    Fewer than k train rows are all neighbours; without any there are no rows."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    n = train.count()
    if not n:
        return spark.createDataFrame([], "test long, id long, label double, d2 double")
    depth = int(min(DEPTH, max(0, np.ceil(np.log2(n / LEAF_ROWS)))))
    part = train if n <= SAMPLE else train.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE)
    dims, cuts = grow(_stack(part.orderBy("id").limit(2 * SAMPLE).select("x").toPandas()["x"]), depth)

    @F.pandas_udf("int")
    def leaf(x: pd.Series) -> pd.Series:
        return pd.Series(leaf_of(_stack(x), dims, cuts).astype(np.int32))

    train = train.select("id", "x", F.col("label").cast("double").alias("label"), leaf("x").alias("leaf")).checkpoint()
    edges = train.select("leaf", F.posexplode("x").alias("j", "v")).groupBy("leaf", "j").agg(F.min("v").alias("low"), F.max("v").alias("high")).toPandas()
    wide = lambda c: edges.pivot(index="leaf", columns="j", values=c).sort_index()
    low, high = wide("low"), wide("high")
    names, low, high = low.index.to_numpy(), low.to_numpy(), high.to_numpy()

    @F.pandas_udf("int")
    def first(x: pd.Series) -> pd.Series:
        return pd.Series(names[box_distance(_stack(x), low, high).argmin(axis=1)].astype(np.int32) if len(x) else np.zeros(0, np.int32))

    @F.pandas_udf("array<int>")
    def others(x: pd.Series, own: pd.Series, d2: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        near = box_distance(_stack(x), low, high) <= d2.to_numpy()[:, None]
        near &= names[None, :] != own.to_numpy()[:, None]
        return pd.Series([names[row].astype(np.int32).tolist() for row in near])

    asked = test.select(F.col("id").alias("test"), "x").withColumn("leaf", first("x")).checkpoint()
    near = _visit(train, asked, k).checkpoint()
    ranked = F.row_number().over(Window.partitionBy("test").orderBy("d2", "id"))
    bound = near.withColumn("k", ranked).filter(F.col("k") == k).select("test", "d2")
    more = asked.join(bound, "test", "left").withColumn("d2", F.coalesce("d2", F.lit(float("inf"))))
    more = more.select("test", "x", F.explode(others("x", "leaf", "d2")).alias("leaf"))
    return near.unionByName(_visit(train, more, k)).withColumn("k", ranked).filter(F.col("k") <= k).drop("k")


def classify(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """(test, prob_up, prediction): the share of label 1 among the neighbours, and whether it is above a half."""
    g = nearest(train, test, k).groupBy("test").agg(F.avg("label").alias("prob_up"))
    return g.withColumn("prediction", (F.col("prob_up") > 0.5).cast("double"))


def standardised(panel: DataFrame, cols: Sequence[str], is_test: str = "is_test") -> DataFrame:
    """``panel`` with ``x``: the columns centred and scaled by the mean and deviation of its train rows."""
    s = panel.filter(~F.col(is_test)).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return panel.withColumn("x", F.array(*[(F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in cols]))
