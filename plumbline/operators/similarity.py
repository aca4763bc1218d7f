"""Cosines of many vectors with many others: blocks of both meet in tasks, as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.durable import durable, small

#: Vectors of either side that meet in one group, on average: what a task holds at a time, whatever the table's size.
BLOCK = (500, 4_000)
#: Partitions that groups are dealt to, at most.
PARTS = 2_000
#: Rows of the matrices that are multiplied at a time; sums stay in the processor's cache.
TILE = (32, 1024)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and doubles of the arrays without nulls, by their length; dimensions first."""
    arrays = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = pc.fill_null(pc.list_value_length(arrays), -1).to_numpy(zero_copy_only=False).copy()
    gaps = pc.is_null(pc.list_flatten(arrays)).to_numpy(zero_copy_only=False)
    lengths[pc.list_parent_indices(arrays).to_numpy(zero_copy_only=False)[gaps]] = -1
    found = {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == n)
        flat = pc.list_flatten(arrays.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False)
        found[n] = at, np.ascontiguousarray(flat.reshape(len(at), n).T)
    return found


def _lengths(x: np.ndarray) -> np.ndarray:
    total = np.zeros(x.shape[1])
    for d in x:
        total += d * d
    return np.sqrt(total)


def _known(norm: np.ndarray) -> np.ndarray:
    """Where scalars.cosine divides; elsewhere it is 0."""
    return (norm > 0) | np.isnan(norm)


def matrix_of_cosines(left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ma.MaskedArray:
    """scalars.cosine of every array with every other, bit by bit: products are added in the order of the dimensions. Masked (null) between
    arrays of different lengths; 0 where one is all zeros, null or holds nulls."""
    out, others = np.ma.zeros((len(left), len(right))), _by_length(right)
    product = np.empty(TILE)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for n, (at, x) in _by_length(left).items():
            norms = _lengths(x)
            for m, (there, y) in others.items():
                norms_y = _lengths(y)
                if m != n:
                    i, j = np.nonzero(_known(norms[:, None] * norms_y[None, :]))
                    out[at[i], there[j]] = np.ma.masked
                    continue
                for i in range(0, len(at), TILE[0]):
                    for j in range(0, len(there), TILE[1]):
                        p, q = x[:, i : i + TILE[0]], y[:, j : j + TILE[1]]
                        total, one = np.zeros((p.shape[1], q.shape[1])), product[: p.shape[1], : q.shape[1]]
                        for d in range(n):
                            np.multiply(p[d][:, None], q[d][None, :], out=one)
                            total += one
                        norm = norms[i : i + TILE[0], None] * norms_y[None, j : j + TILE[1]]
                        out.data[np.ix_(at[i : i + TILE[0]], there[j : j + TILE[1]])] = np.where(_known(norm), total / norm, 0.0)
    return out


def _met(left: pa.Table, right: pa.Table) -> pa.Table:
    a, b = left.column("id_0").to_numpy(), right.column("id_1").to_numpy()
    other = a[:, None] != b[None, :]
    i, j = np.nonzero(other)
    found = matrix_of_cosines(left.column("vector_0"), right.column("vector_1"))[other]
    return pa.table({"a": a[i], "b": b[j], "cosine": pa.array(found.data, mask=np.ma.getmaskarray(found))})


def cosines(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """a (of queries), b (of rows) and cosine of all pairs of one group with different ids. Both: id (long), group, vector. Rows without
    id or group meet nothing."""
    sides = [df.select("id", "group", "vector").filter(F.col("id").isNotNull() & F.col("group").isNotNull()) for df in (queries, rows)]
    n = [df.groupBy("group").agg(F.ceil(F.count("*") / F.lit(size)).alias(f"blocks_{k}")) for k, (df, size) in enumerate(zip(sides, BLOCK))]
    sizes = durable(n[0].join(n[1], "group"))
    cells = sizes.agg(F.sum(F.col("blocks_0") * F.col("blocks_1"))).first()[0] or 1
    blocks = small(sizes)

    def dealt(k: int) -> DataFrame:
        """Side k, each row in its own block, with every block of the other side."""
        own: Column = F.pmod(F.xxhash64("id"), F.col(f"blocks_{k}"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"blocks_{1 - k}") - 1))
        named = [F.col(c).alias(f"{c}_{k}") for c in ("id", "vector", "group")]
        placed = sides[k].join(blocks, "group").select(*named, own.alias(f"block_{k}"), other.alias(f"block_{1 - k}"))
        # a number of partitions by the pairs to be made: by bytes, all of them might go to one task
        return placed.repartition(int(min(cells, PARTS)), f"group_{k}", "block_0", "block_1").groupBy(f"group_{k}", "block_0", "block_1")

    return dealt(0).cogroup(dealt(1)).applyInArrow(_met, "a long, b long, cosine double")
