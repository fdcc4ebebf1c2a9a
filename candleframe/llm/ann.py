"""Approximate nearest neighbours by inner product on shifted Hilbert curves.

Each of ``CURVES`` curves projects the vectors on ``DIMENSIONS`` random orthonormal
directions, shifts them at random, and orders all rows by their place on a Hilbert curve
through the projected space. Vectors get one more coordinate that makes all norms equal, so
near in this space means a large inner product. Spark range-partitions all curves at once
by (curve, place, id) and numbers the rows. A query is compared with the rows within a
window on either side of it on every curve; the windows' candidates are merged and ranked
by the inner product of the original vectors in double precision.

The window is fitted: for a bounded sample of queries (``SAMPLE``) the exact neighbours are
found by a scan, and the window is the distance on the closest curve within which the share
``RECALL`` of those lies. Data without structure thus get wide windows and clustered data
narrow ones; every row is indexed either way. Windows are dealt out in blocks of rows.

Defined results: rows with a null id, and vectors that are null, zero, or hold null or
non-finite components take no part, nor do vectors of another length than the most frequent
one (the longer on a tie); rows that share an id count once, with the greatest vector;
fewer candidates than k are all returned; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candleframe.llm.common import written

CURVES, DIMENSIONS, BITS = 8, 6, 10
#: Queries whose exact neighbours fit the window, at most, and the share of these to reach.
SAMPLE, RECALL = 128, 0.96
#: Rows of one block, at most and at least.
BLOCK, SMALL = 16_384, 256


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below 2^bits; bits * columns <= 62.

    The recursive reflections and exchanges of the curve are undone from the highest bit
    down, then the Gray code, and the bits of the columns are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for k in range(len(x)):
            on = (x[k] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            x[k] ^= swap
        bit >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    bit = top
    while bit > 1:
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            place = (place << 1) | ((row >> b) & 1)
    return place


def directions(width: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal columns (as many as there are, ``DIMENSIONS`` at most) and a shift in [0, 1) for each."""
    rng = np.random.Generator(np.random.PCG64([7, curve]))
    basis, _ = np.linalg.qr(rng.standard_normal((width, width)))
    basis = basis[:, :DIMENSIONS]
    return basis, rng.random(basis.shape[1])


def places(vectors: np.ndarray, norm: float, curve: int) -> np.ndarray:
    """Places on a curve of vectors whose norms are at most ``norm``."""
    more = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
    basis, shift = directions(vectors.shape[1] + 1, curve)
    unit = (np.column_stack((vectors, more)) @ basis / norm + 1) / 2  # in [0, 1]
    cells = ((unit + shift) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.array([np.frombuffer(v, dtype=kind) for v in column.to_pylist()], dtype=np.float64)


def best(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k rows of greatest inner product, but for the row ``own``; ties to smaller ids."""
    rough = rows @ query
    rough[ids == own] = -np.inf
    if len(rough) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = np.flatnonzero(rough >= least - 1e-9 * max(1.0, abs(least)))
    else:
        at = np.arange(len(rough))
    at = at[ids[at] != own]
    score = (rows[at] * query).sum(axis=1)  # the same sum wherever a row stands
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


_PAIRS = "query_id long, vec_id long, score double"


def _pairs(query: list, vec: list, score: list) -> pa.RecordBatch:
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(cat(query, np.int64), pa.int64()), pa.array(cat(vec, np.int64), pa.int64()), pa.array(cat(score, float), pa.float64())], names=["query_id", "vec_id", "score"])


def top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query, numbered; equal pairs count once."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(df: DataFrame, key: str, vector: str, query: Column) -> tuple[DataFrame, str]:
    """(id, query, vector as bytes, norm) of the rows that take part, and the numpy type of the bytes."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("query"), F.col(vector).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    rows = rows.groupBy("id").agg(F.max("query").alias("query"), F.max("v").alias("v"))
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"

    def pack(batches):
        for batch in batches:
            own = [np.array(v, dtype=kind) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(v) for v in own], pa.int32()), pa.array([v.tobytes() for v in own], pa.binary()), pa.array([float(np.sqrt((v.astype(float) ** 2).sum())) for v in own], pa.float64())], names=["id", "query", "width", "v", "norm"])

    return written(rows.mapInArrow(pack, "id long, query boolean, width int, v binary, norm double"), "ann-vectors"), kind


def scan(rows: DataFrame, queries: list, kind: str, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of (id, bytes) queries among all rows."""
    held = rows.sparkSession.sparkContext.broadcast([(q, np.frombuffer(v, dtype=kind).astype(float)) for q, v in queries])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1), kind)
            found = [(q, *best(v, matrix, ids, q, k)) for q, v in held.value]
            yield _pairs([np.full(len(i), q) for q, i, _ in found], [i for _, i, _ in found], [s for *_, s in found])

    return top(rows.select("id", "v").mapInArrow(run, _PAIRS), k)


def ordered(rows: DataFrame, norm: float, kind: str) -> DataFrame:
    """All rows on all curves: curve, place in the order of (curve, Hilbert place, id), id, query, vector."""

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column(2), kind)
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c), pa.int32()), pa.array(places(matrix, norm, c), pa.int64()), *batch.columns], names=["curve", "key", "id", "query", "v"])

    def number(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = np.arange(done, done + batch.num_rows)
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(at, pa.int64()), batch.column(0), *batch.columns[2:]], names=["part", "at", "curve", "id", "query", "v"])

    spread_out = rows.select("id", "query", "v").mapInArrow(spread, "curve int, key long, id long, query boolean, v binary")
    dealt = spread_out.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    table = written(dealt.mapInArrow(number, "part int, at long, curve int, id long, query boolean, v binary"), "ann-order")
    sizes = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return table.join(F.broadcast(offsets), "part").select("curve", (F.col("start") + F.col("at")).alias("place"), "id", "query", "v")


def fitted_window(order: DataFrame, truth: DataFrame) -> int:
    """Distance on the closest curve that holds the share ``RECALL`` of the true pairs."""
    at = order.select("curve", "place", "id")
    q = truth.select("query_id", "vec_id").join(at.withColumnRenamed("id", "query_id"), "query_id").withColumnRenamed("place", "from")
    d = q.join(at.withColumnRenamed("id", "vec_id"), ["vec_id", "curve"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("place") - F.col("from"))).alias("d"))
    found = d.agg(F.percentile("d", F.lit(RECALL)).alias("w")).first()["w"]
    return int(found or 0) + 1


def search(df: DataFrame, key: str, vector: str, query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row that ``query`` marks."""
    rows, kind = usable(df, key, vector, query)
    widths = rows.groupBy("width").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.col("width") == widths["width"])
    order = ordered(rows, widths["norm"], kind)
    sample = rows.filter("query").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").collect()
    window = fitted_window(order, scan(rows, [(r["id"], r["v"]) for r in sample], kind, k)) if sample else 1
    block = max(min(window, BLOCK), SMALL)

    member = order.select(F.expr(f"place DIV {block}").alias("block"), F.lit(0).alias("probe"), "curve", "id", "v")
    first, last = F.expr(f"greatest(place - {window}, 0) DIV {block}"), F.expr(f"(place + {window}) DIV {block}")
    probe = order.filter("query").select(F.explode(F.sequence(first, last)).alias("block"), F.lit(1).alias("probe"), "curve", "id", "v")
    dealt = member.unionByName(probe).repartition("block").sortWithinPartitions("block", "probe", "curve", "id")

    def compare(batches):
        now, held, out = None, None, ([], [], [])
        members: list[tuple] = []
        for batch in batches:
            for b, is_probe, c, i, v in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if b != now:
                    now, held, members = b, None, []
                if not is_probe:
                    members.append((c, i, v))
                    continue
                if not members:
                    continue
                if held is None:
                    held = {}
                    curves = np.array([m[0] for m in members])
                    ids = np.array([m[1] for m in members], dtype=np.int64)
                    matrix = np.frombuffer(b"".join(m[2] for m in members), dtype=kind).reshape(len(members), -1).astype(np.float64)
                    for curve in np.unique(curves).tolist():
                        own = curves == curve
                        held[curve] = (matrix, ids) if own.all() else (matrix[own], ids[own])
                if c in held:
                    matrix, ids = held[c]
                    near, score = best(np.frombuffer(v, dtype=kind).astype(np.float64), matrix, ids, i, k)
                    out[0].append(np.full(len(near), i))
                    out[1].append(near)
                    out[2].append(score)
            yield _pairs(*out)
            out = ([], [], [])

    return top(dealt.mapInArrow(compare, _PAIRS), k)
