"""Isolation forest: random-split trees on bounded samples, path lengths over the whole panel.

Each of ``TREES`` trees is grown in its own task from about ``SAMPLE`` rows, drawn for the tree by a hash of
the row's key, so the same rows are drawn however the data are partitioned. The forest is bounded (fewer than ``2 * SAMPLE``
nodes a tree) and goes to the tasks with the scoring function, which walks all rows of a batch down
one tree at a time in numpy. A row's score is ``2 ** -mean(h / c(n))`` with ``h`` its path length in a tree of
``n`` rows and ``c`` the mean path of an unsuccessful search: near 1 for rows that few splits isolate.

Rows whose vector is null or holds a null get no score. Equal rows get equal scores. Without any row there
is no forest and no score.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, SAMPLE, SEED = 100, 256, 42
#: Fixed value: the share of the train rows that the reference calls outliers.
CONTAMINATION = 0.1

Tree = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 2.0)
    return np.where(n > 2, 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, seed: int) -> Tree:
    """(rows, dimension, cut, first child, path length at a leaf) of a tree; a leaf's first child is -1."""
    rng = np.random.default_rng(seed)
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    dim, cut, child, path = [0], [0.0], [-1], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, own, depth = todo.pop()
        low, high = own.min(axis=0), own.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= limit or len(own) < 2 or not len(wide):
            path[node] = depth + float(mean_path(len(own)))
            continue
        dim[node] = int(rng.choice(wide))
        cut[node] = float(rng.uniform(low[dim[node]], high[dim[node]]))
        left = own[:, dim[node]] <= cut[node]
        child[node] = len(dim)
        for part in (own[left], own[~left]):
            todo.append((len(dim), part, depth + 1))
            dim.append(0), cut.append(0.0), child.append(-1), path.append(0.0)
    return len(x), np.array(dim), np.array(cut), np.array(child), np.array(path)


def path_lengths(x: np.ndarray, tree: Tree) -> np.ndarray:
    """The path length of each row."""
    _, dim, cut, child, path = tree
    node = np.zeros(len(x), dtype=np.int64)
    live = np.flatnonzero(child[node] >= 0)
    while len(live):
        at = node[live]
        node[live] = child[at] + (x[live, dim[at]] > cut[at])
        live = live[child[node[live]] >= 0]
    return path[node]


def fit_forest(df: DataFrame, key: str, x: str = "x", trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> list[Tree]:
    """The trees from the rows of ``df`` with a whole vector; ``key`` is a long that names a row."""
    rows = df.filter(F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))).select(F.col(key).alias("key"), F.col(x).alias("x"))
    n = rows.count()
    if not n:
        return []
    share = min(1.0, sample / n)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("key", t, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * share))

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        t = int(group["tree"].iloc[0])
        size, dim, cut, child, path = grow(np.stack(group["x"].to_numpy()).astype(float), seed * 1_000_003 + t)
        return pd.DataFrame({"tree": [t], "size": [size], "dim": [dim.tolist()], "cut": [cut.tolist()], "child": [child.tolist()], "path": [path.tolist()]})

    planted = rows.select("key", "x", F.explode(drawn).alias("tree")).groupBy("tree").applyInPandas(plant, "tree int, size int, dim array<int>, cut array<double>, child array<int>, path array<double>")
    got = planted.orderBy("tree").collect()  # trees x 2 * sample nodes
    return [(r["size"], np.array(r["dim"]), np.array(r["cut"]), np.array(r["child"]), np.array(r["path"])) for r in got]


def score_forest(df: DataFrame, forest: list[Tree], x: str = "x", out: str = "anomaly") -> DataFrame:
    """``df`` with the score of each row (0 to 1)."""
    if not forest:
        return df.withColumn(out, F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=float)
        m = np.stack(column.to_numpy()).astype(float)
        total = np.zeros(len(m))
        for tree in forest:
            total += path_lengths(m, tree) / max(float(mean_path(tree[0])), 1.0)
        return pd.Series(np.exp2(-total / len(forest)))

    whole = F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    width = len(forest) and max(int(t[1].max()) for t in forest) + 1
    # A Python column is computed for every row: rows without a whole vector pass zeros and lose the result.
    safe = F.when(whole, F.col(x)).otherwise(F.array(*[F.lit(0.0)] * max(width, 1)))
    padded = F.concat(safe, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(width) - F.size(safe))))
    return df.withColumn("_safe", padded).withColumn(out, score("_safe")).withColumn(out, F.when(whole, F.col(out))).drop("_safe")


def outliers(scored: DataFrame, train: DataFrame, contamination: float = CONTAMINATION, score: str = "anomaly") -> DataFrame:
    """``scored`` with ``inlier`` (1.0 or 0.0): the score is at most the train rows' (1 - contamination) quantile."""
    bound = train.agg(F.percentile_approx(score, 1.0 - contamination, 10_000)).first()[0]
    return scored.withColumn("inlier", (F.col(score) <= F.lit(bound)).cast("double") if bound is not None else F.lit(None).cast("double"))
