"""Whitening of embeddings by shifted CholeskyQR (operator 13).

A row's entries c become integers x = floor(1024 * c) + 100000. Steps, each a pass of all partitions over the same kept rows:

1. Sums of each dimension, exact (integers within tasks, decimals across them).
2. Gram passes. Rows are centred before anything is multiplied, divided by the R factors found so far in triangular solves, and
   their d x d products summed per partition; partition sums meet FAN_IN at a time, so neither a task nor the driver
   sees more than FAN_IN of them. The driver takes the Cholesky factor of one d x d matrix a pass. The first pass adds a shift that keeps the
   factor real; passes go on until the rows are orthonormal, and later ones shift only where they must.
3. The product of the factors, R, has the singular values and right vectors of the centred rows: components, eigenvalues, trace.
4. The covariance of the whitened rows themselves, centred, gives identity_error.

Defined results: a row whose vector is null or holds null, NaN or infinite entries is dropped; repeated rows and rows with a null
vec_id count each; shorter vectors, empty ones included, have entries 0 at their end up to the longest length; x beyond
2^40 in size is held there; a deviation beyond a long is null. Components without variance (singular value below SMALLEST of the
largest, as with fewer rows than dimensions or equal rows) are left out, so an empty table or one row gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, finite, matrix, table

SCALE, OFFSET = 1024, 100_000
#: x is held within this.
LARGEST = 1 << 40
COMPONENTS = 8
#: Partition sums that meet in one task.
FAN_IN = 64
#: Gram passes at most, and the distance from orthonormal rows that ends them.
PASSES, ORTHONORMAL = 8, 1e-13
#: Singular values below this share of the largest are rounding.
SMALLEST = 1e-13
_UNIT = 2.0**-53


@dataclass
class Whitening:
    """What whitening needs: n rows, the exact sums, R, and the components (columns) with their eigenvalues."""

    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    components: np.ndarray | None = None
    eigenvalues: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts are taken off exactly before the fraction."""
        whole = [s // self.n for s in self.sums]
        return (x - np.array(whole, np.int64)) - np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S)^2, exact; null beyond a long."""
        whole = [s // self.n for s in self.sums]
        rest = [s - w * self.n for s, w in zip(self.sums, whole)]
        off = x - np.array(whole, np.int64)
        if x.size and x.shape[1] * (float(np.abs(off).max()) + 1) ** 2 * float(self.n) ** 2 < 2.0**62:
            return ((off * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((int(o) * self.n - r) ** 2 for o, r in zip(row, rest)) for row in off.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def solve_rows(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows * inverse(r) for an upper triangular r, column by column."""
    out = np.empty_like(rows)
    for j in range(r.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows that take part."""
    held = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))) + OFFSET, F.lit(-LARGEST)), F.lit(LARGEST))
    return embeddings.filter(finite(F.col("embedding"))).select("vec_id", F.transform("embedding", held).alias("x"))


def exact_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for b in batches:
            x = matrix(b.column(0), dims, OFFSET)
            n, total = n + len(x), [t + int(s) for t, s in zip(total, x.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["dim", "n", "total"])

    got = rows.select("x").mapInArrow(run, "dim int, n long, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    return (got[0].n, [int(r.total) for r in got]) if got else (0, [0] * dims)


def summed(rows: DataFrame, dims: int, products: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all batches of rows of products(x), a matrix of that shape: per partition, then FAN_IN at a time."""
    schema = "part int, total binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape), 0
        for b in batches:
            total, n = total + products(matrix(b.column(0), dims, OFFSET)), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = sum(np.frombuffer(b, float) for b in t.column("total").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x").mapInArrow(run, schema)
    width = rows.rdd.getNumPartitions()
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        parts = parts.groupBy((F.col("part") % width).alias("group")).applyInArrow(add, schema)
    return sum((np.frombuffer(bytes(r.total), float).reshape(shape) for r in parts.orderBy("part").collect()), np.zeros(shape))


def factor_of(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular Cholesky factor; the shift is the smallest that keeps rounding from breaking it."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * _UNIT * max(np.linalg.norm(gram, 2), np.finfo(float).tiny * 1e16)
    if not shifted and np.linalg.eigvalsh(gram)[0] > 100 * d * _UNIT:
        shift = 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, d * _UNIT)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """rows: x (see integers), kept durably; every pass reads them again."""
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums = exact_sums(rows, dims)
    found = Whitening(n, sums, components=np.zeros((dims, 0)), eigenvalues=np.zeros(0))
    if n < 2 or not dims:
        return found
    whole = np.eye(dims)
    for k in range(PASSES):

        def products(x: np.ndarray) -> np.ndarray:
            q = found.centred(x)
            for r in found.factors:
                q = solve_rows(q, r)
            return q.T @ q

        gram = summed(rows, dims, products, (dims, dims))
        if not gram.any():
            break
        r = factor_of(gram, n, k == 0)
        whole = r @ whole
        found.factors.append(r)
        if np.abs(gram - np.eye(dims)).max() < ORTHONORMAL * dims:
            break
    if not found.factors:
        return found
    _, sigma, right = np.linalg.svd(whole)
    kept = min(components, int((sigma > SMALLEST * sigma[0]).sum()))
    v = right[:kept].T
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(kept)])
    found.components, found.eigenvalues, found.trace = v, sigma[:kept] ** 2 / n, float((sigma**2).sum() / n)

    def covariance(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = summed(rows, dims, covariance, (kept + 1, kept)) / n
    found.identity_error = float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(kept)).max())
    return found


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, found: Whitening) -> DataFrame:
    """A row per row and component."""
    kept = found.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), len(found.sums), OFFSET)
            if not kept or not len(x):
                continue
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(x)), kept)))
            deviation = pa.array(found.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), kept)))
            explained = np.tile(found.eigenvalues / found.trace, len(x))
            same = lambda v, kind: pa.array(np.full(len(ids), v), kind)
            columns = [ids.cast(pa.int64()), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), same(found.n, pa.int64()), deviation, pa.array(found.whitened(x).ravel()), pa.array(explained), same(found.identity_error, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in OUT.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, OUT)


def op13(spark, sf_dir: str) -> DataFrame:
    rows = durable(integers(table(spark, sf_dir, "embeddings")))
    return whiten(rows, fit(rows))
