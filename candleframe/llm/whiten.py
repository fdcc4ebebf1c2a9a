"""Whitening of embeddings by spectrum slicing of their covariance.

Entries are put on a grid of integers, ``x = floor(64 * c) + 1000000``. Spark takes the distinct
grid vectors (the fit list), sums them, and sums the products of the vectors centred at their
mean rounded down; all sums are of integers and exact, so the covariance V, whose last step
subtracts the product of what the rounding left over, is exact up to its final rounding to
doubles and does not depend on how the rows are dealt out. Only V, one number for each pair
of dimensions, reaches the driver.

There the leading eigenvalues are found by slicing the spectrum: the inertia of an LDL^T
factorisation of V - sI (symmetric pivoting, pivots of one or two rows) counts the eigenvalues
above s. Halving isolates each wanted eigenvalue in an interval of its own; Rayleigh quotient
iteration converges in it cubically, and counts on both sides of the value it ends at certify
its number. Eigenvalues that no interval of ``CLOSE`` times the largest can part are taken
together: their space is found by inverse iteration on a block and Rayleigh-Ritz in it.

Defined results: rows whose vector is null, or holds null or non-finite entries or entries
beyond 2^46 in size, take no part, nor do vectors of another length than the most frequent one
(the longer on a tie); repeated rows are all returned and fitted once; null ids are returned
as they are; components whose eigenvalue is not above ``RANK`` times the largest (constant or
dependent dimensions, a single vector) can not be whitened and are left out, so a table may have
no rows; a deviation beyond 64 bits is null; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleframe.llm.common import free_name, written

SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues nearer than this share of the largest one are one cluster.
CLOSE = 1e-13
#: Eigenvalues up to this share of the largest one, times the dimension, count as zero.
RANK = 1e-12
#: Rows whose products are summed in doubles before they are added up as integers.
ROWS = 4096

_ALPHA = (1 + np.sqrt(17)) / 8


def positive_pivots(a: np.ndarray) -> int:
    """How many eigenvalues of the symmetric matrix ``a`` are above zero, by the inertia of its LDL^T.

    Pivots of one row, or of two where the diagonal is small beside the rest, are brought to the
    front symmetrically; what remains is updated by the factor's columns. A pivot that is
    exactly zero counts as not above.
    """
    a = a.copy()
    n, above = len(a), 0
    k = 0
    while k < n:
        size = 1
        rest = np.abs(a[k + 1 :, k])
        if len(rest):
            most = rest.max()
            if abs(a[k, k]) < _ALPHA * most:
                r = k + 1 + int(rest.argmax())
                beside = np.abs(a[r, k:])
                beside[r - k] = 0
                if abs(a[k, k]) * beside.max() < _ALPHA * most * most:
                    if abs(a[r, r]) >= _ALPHA * beside.max():
                        _swap(a, k, r)
                    else:
                        _swap(a, k + 1, r)
                        size = 2
        if size == 1:
            d = a[k, k]
            above += d > 0
            if d != 0:
                column = a[k + 1 :, k] / d
                a[k + 1 :, k + 1 :] -= np.outer(column, a[k, k + 1 :])
        else:  # a pivot of two rows has a negative determinant: one eigenvalue on each side
            above += 1
            d = a[k : k + 2, k : k + 2]
            below = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(d, below.T)
        k += size
    return int(above)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    The entry of largest size of each vector is positive.
    """
    n = len(v)
    wanted = min(wanted, n)
    spread = float(np.abs(v).sum(axis=1).max()) if n else 0.0
    if not wanted or not spread:
        return np.zeros(wanted), np.eye(n)[:, :wanted]
    v = v / spread  # all eigenvalues in [-1, 1]
    tiny = CLOSE
    counts: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = positive_pivots(v - s * np.eye(n))
        return counts[s]

    def slices(low: float, high: float, first: int, last: int) -> Iterator[tuple[float, float, int, int]]:
        """Intervals (low, high], highest first, of the eigenvalues numbered first to last, falling, in it."""
        while (last > first or above(low) > last) and high - low > tiny:
            middle = (low + high) / 2
            here = above(middle)
            if here >= last:
                low = middle
            elif here < first:
                high = middle
            else:
                yield from slices(middle, high, first, here)
                first, high = here + 1, middle
        yield low, high, first, last

    values, vectors = np.zeros(wanted), np.zeros((n, 0))
    rng = np.random.Generator(np.random.PCG64(7))
    for low, high, first, last in list(slices(-1.0 - tiny, 1.0 + tiny, 1, wanted)):
        start = rng.standard_normal((n, last - first + 1))
        if first == last:
            e, q = _single(v, low, high, first, start[:, 0], vectors, above)
            e, q = np.array([e]), q[:, None]
        else:
            e, q = _cluster(v, (low + high) / 2, start, vectors)
        values[first - 1 : last] = e[: wanted - first + 1]
        vectors = np.hstack((vectors, q))
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return values[order] * spread, vectors * sign


def _apart(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """``x`` without its parts along the eigenvectors found so far, at unit length."""
    for _ in range(2):
        x = x - found @ (found.T @ x)
    return x / np.linalg.norm(x, axis=0)


def _solve(v: np.ndarray, s: float, x: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(v - s * np.eye(len(v)), x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(v - (s + 2.0**-52) * np.eye(len(v)), x)


def _single(v: np.ndarray, low: float, high: float, number: int, x: np.ndarray, found: np.ndarray, above) -> tuple[float, np.ndarray]:
    """The eigenpair whose value alone lies in (low, high], certified by counts."""
    x = _apart(x, found)
    while True:
        s = (low + high) / 2
        for _ in range(3):  # towards the eigenvalue nearest to the middle of its interval
            x = _apart(_solve(v, s, x), found)
        e = float(x @ v @ x)
        for _ in range(8):
            left = float(np.linalg.norm(v @ x - e * x))
            if left <= 2.0**-50 or not low < e <= high:
                break
            x = _apart(_solve(v, e, x), found)
            e = float(x @ v @ x)
        near = max(float(np.linalg.norm(v @ x - e * x)) * 2, 2.0**-46)
        if low < e <= high and above(e - near) >= number and above(e + near) < number:
            return e, x
        if high - low <= CLOSE:
            return e, x  # counts and iteration differ by rounding only
        s = (low + high) / 2
        low, high = (s, high) if above(s) >= number else (low, s)


def _cluster(v: np.ndarray, s: float, x: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs that no interval parts: inverse iteration on a block, then Rayleigh-Ritz."""
    x = np.linalg.qr(_apart(x, found))[0]
    for _ in range(6):
        x = np.linalg.qr(_apart(_solve(v, s, x), found))[0]
    e, turn = np.linalg.eigh(x.T @ v @ x)
    return e[::-1], (x @ turn)[:, ::-1]


@dataclass
class Whitening:
    """A fitted whitening: rows and sums of the fit list, components, and their shares of the variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of grid vectors (rows of 64-bit integers)."""
        centre = np.array([s // self.n for s in self.sums], dtype=np.int64)
        left = np.array([float(Fraction(s - self.n * int(c), self.n)) for s, c in zip(self.sums, centre, strict=True)])
        return ((x - centre).astype(np.float64) - left) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2 for each row; None beyond 64 bits."""
        centre = np.array([s // self.n for s in self.sums], dtype=np.int64)
        left = np.array([s - self.n * int(c) for s, c in zip(self.sums, centre, strict=True)], dtype=object)
        y = x - centre
        most = max(int(np.abs(y).max(initial=0)) * self.n + self.n, 1)
        if most * most * max(y.shape[1], 1) < 2**63:
            return ((self.n * y - left.astype(np.int64)) ** 2).sum(axis=1).tolist()
        full = ((self.n * y.astype(object) - left) ** 2).sum(axis=1)
        return [int(f) if f < 2**63 else None for f in full]


def on_grid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x): the grid vectors of the rows that take part."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= 2.0**46))
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & fine)
    rows = written(rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x")), "whiten-grid")
    width = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return rows.filter(F.size("x") == F.lit(width["w"])) if width else rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width).astype(np.int64) if len(column) else np.zeros((0, width), np.int64)


def _totals(table: DataFrame, run, names: int) -> list:
    """Sums of (i, j, value) rows over all tasks; one row for each pair of dimensions comes back."""
    rows = table.mapInArrow(run, "i int, j int, v decimal(38,0)" if names == 0 else "i int, j int, v double")
    return rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()


def _triples(values, kind: pa.DataType) -> pa.RecordBatch:
    d, e = values.shape
    i, j = np.indices((d, e))
    return pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(values.ravel().tolist(), kind)], names=["i", "j", "v"])


def products(distinct: DataFrame, centre: np.ndarray) -> list[list[int]]:
    """Exact sums of the products of each pair of dimensions over grid vectors less ``centre``."""
    width = len(centre)

    def run(batches):
        total = np.zeros((width, width), dtype=object)
        for batch in batches:
            y = _matrix(batch.column(0), width) - centre
            most = int(np.abs(y).max(initial=0))
            if most * most * ROWS < 2**53:  # whole numbers below 2^53 add up exactly as doubles
                for k in range(0, len(y), ROWS):
                    part = y[k : k + ROWS].astype(np.float64)
                    total = total + (part.T @ part).astype(np.int64).astype(object)
            else:
                y = y.astype(object)
                total = total + y.T.dot(y)
        yield _triples(total, pa.decimal128(38))

    out = [[0] * width for _ in range(width)]
    for r in _totals(distinct, run, 0):
        out[r.i][r.j] = int(r.v)
    return out


def fit(distinct: DataFrame, components: int) -> Whitening | None:
    """The whitening of distinct grid vectors (column x); None if there are none."""
    n = distinct.count()
    if not n:
        return None
    width = distinct.select(F.size("x")).first()[0]
    sums = [0] * width
    for r in distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect():
        sums[r.i] = int(r.s)
    centre = np.array([s // n for s in sums], dtype=np.int64)
    left = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    both = products(distinct, centre) if width else []
    v = np.array([[float(Fraction(n * both[i][j] - left[i] * left[j], n * n)) for j in range(width)] for i in range(width)]).reshape(width, width)
    values, vectors = leading(v, components)
    some = values > RANK * width * values.max(initial=0)
    values, vectors = values[some], vectors[:, some]
    return Whitening(n, sums, values, vectors, values / np.trace(v) if len(values) else values)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry, in size, of the whitened fit list's covariance less the identity, measured on the rows."""
    width, k = len(model.sums), len(model.values)

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.apply(_matrix(batch.column(0), width))
            total += np.vstack((w.T @ w, w.sum(axis=0)))
        yield _triples(total, pa.float64())

    total = np.zeros((k + 1, k))
    for r in _totals(distinct, run, 1):
        total[r.i, r.j] = r.v
    mean = total[k] / model.n  # the rows are centred already, this is what rounding left
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, key: str, vector: str, components: int = 16) -> DataFrame:
    """One row for each usable row of ``df`` and component.

    Columns: the key, component (from 1), n, deviation, whitened, explained, identity_error.
    """
    rows = on_grid(df, key, vector)
    distinct = written(rows.select("x").distinct(), "whiten-distinct")
    model = fit(distinct, components)
    schema = "deviation long, whitened array<double>"
    name = free_name(df.select(key), "component")
    error = identity_error(distinct, model) if model and len(model.values) else 0.0
    shares = [float(e) for e in model.explained] if model else []
    n = model.n if model else 0
    width = len(model.sums) if model else 0

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            w = model.apply(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel()))], names=["id", "deviation", "whitened"])

    done = rows.filter(F.lit(bool(shares))).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}")
    share = F.element_at(F.array(*map(F.lit, shares)) if shares else F.array(F.lit(0.0)), F.col(name))
    out = done.select(F.col("id").alias(key), "deviation", F.posexplode("whitened").alias("k", "whitened"))
    out = out.withColumn(name, F.col("k") + 1)
    return out.select(key, name, F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
