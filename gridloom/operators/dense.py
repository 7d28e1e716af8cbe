"""Small dense systems, one per row: matrices as arrays in row-major order.

Rows are dealt as they come and solved in Arrow batches, one LAPACK call for each; a row whose matrix
is singular, or whose array has another length, gets null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.scalar import packed_upper


def _table(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``size`` numbers, and which rows have so many, all finite."""
    out, good = np.zeros((len(column), size)), np.zeros(len(column), bool)
    for k, row in enumerate(column.to_pylist()):
        if row is not None and len(row) == size and all(x is not None and np.isfinite(x) for x in row):
            out[k], good[k] = row, True
    return out, good


def _work(n: int, rights: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: the matrix, ``rights`` right-hand sides, then what is kept. Adds det, inverse and a solution for each right-hand side, from one factorisation."""
    for batch in batches:
        a, good = _table(batch.column(0), n * n)
        a = a.reshape(-1, n, n)
        a[~good] = np.eye(n)
        sign, size = np.linalg.slogdet(a)
        det = sign * np.exp(size)
        good &= det != 0
        a[~good] = np.eye(n)
        inverse = np.linalg.solve(a, np.broadcast_to(np.eye(n), a.shape))
        found = []
        for k in range(rights):
            y, ok = _table(batch.column(1 + k), n)
            x = np.linalg.solve(a, y[:, :, None])[:, :, 0]
            found.append(pa.array([row if g else None for row, g in zip(x.tolist(), good & ok, strict=True)], pa.list_(pa.float64())))
        flat = inverse.reshape(-1, n * n).tolist()
        columns = [*batch.columns[1 + rights :], pa.array(np.where(good, det, 0.0)), pa.array([x if g else None for x, g in zip(flat, good, strict=True)], pa.list_(pa.float64())), *found]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1 + rights :], "det", "inverse", *(f"x{k}" for k in range(rights))])


def factored(rows: DataFrame, n: int, matrix: str, rights: list[str], keep: list[str]) -> DataFrame:
    """keep, det (0 for what can't be inverted), inverse and x0, x1, ... (null there): the n by n matrix of each row against its right-hand sides."""
    one = rows.select(F.col(matrix).cast("array<double>").alias("_a"), *[F.col(r).cast("array<double>").alias(f"_y{k}") for k, r in enumerate(rights)], *keep)
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType(one.schema.fields[1 + len(rights) :]).add("det", T.DoubleType()).add("inverse", numbers)
    for k in range(len(rights)):
        schema = schema.add(f"x{k}", numbers)
    return one.mapInArrow(partial(_work, n, len(rights)), schema)


def back_substituted(packed: Column, y: Column, n: int) -> Column:
    """x of U x = y for an upper triangle in packed columns (i, j) at i + j (j + 1) / 2, as an expression of the row; null where a diagonal entry is 0."""
    at = lambda i, j: F.get(packed, packed_upper(i, j).cast("int"))

    def step(found, i):
        """``found`` holds x[i+1..n-1]."""
        later = F.transform(found, lambda x, k: x * at(i, i + 1 + k))
        rest = F.get(y, i) - F.aggregate(later, F.lit(0.0), lambda a, b: a + b)
        return F.concat(F.array(rest / F.nullif(at(i, i), F.lit(0.0))), found)

    return F.aggregate(F.sequence(F.lit(n - 1), F.lit(0)), F.array().cast("array<double>"), step)
