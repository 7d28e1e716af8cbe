"""Restarted, preconditioned GMRES over vectors in long form.

A vector is a table (keys..., v); a key that isn't there is 0. The operator is a function
of such tables. A step writes one table to the shared folder, which has the operator's
result beside the basis vectors, an array for each key, and deletes the table of the step
before: orthogonalization is arithmetic within its rows, and only inner products, all
those of a pass in one job, come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scratch import Scratch

Vector = DataFrame


class Solution(NamedTuple):
    x: DataFrame
    residual: float  # over the norm of the right-hand side
    steps: int


def total(keys: list[str], parts: list[tuple[float, Vector]]) -> Vector:
    """Weighted sum of vectors, combined before the shuffle."""
    scaled = [p.select(*keys, (F.col("v") * float(w)).alias("v")) for w, p in parts]
    return reduce(DataFrame.unionByName, scaled).groupBy(*keys).agg(F.sum("v").alias("v"))


def norm(a: Vector) -> float:
    return float(np.sqrt(a.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0))


def weighted(weights: np.ndarray) -> Column:
    """The basis vectors of a row, weighted and summed."""
    return reduce(Column.__add__, [F.col("q")[i] * float(w) for i, w in enumerate(weights)])


def dots(rows: DataFrame, v: Column, count: int) -> np.ndarray:
    """Inner products of v with each of the basis vectors, and the square of its norm, in one job."""
    each = [F.coalesce(F.sum(v * F.col("q")[i]), F.lit(0.0)).alias(f"d{i}") for i in range(count)]
    return np.array(rows.agg(*each, F.coalesce(F.sum(v * v), F.lit(0.0)).alias("square")).first(), float)


def beside(keys: list[str], w: Vector, basis: DataFrame, count: int) -> DataFrame:
    """keys, v of w, q of the basis: zeros where either has no row."""
    own = basis.select(*[F.col(k).alias(f"b_{k}") for k in keys], "q")
    on = reduce(Column.__and__, [F.col(k) == F.col(f"b_{k}") for k in keys])
    every = w.join(own, on, "full")
    return every.select(*[F.coalesce(k, f"b_{k}").alias(k) for k in keys], F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("q", F.array_repeat(F.lit(0.0), count)).alias("q"))


def jacobi(keys: list[str], diagonal: DataFrame) -> Callable[[Vector], Vector]:
    """Division by a diagonal (keys..., v), of which no entry is 0."""
    own = diagonal.select(*[F.col(k).alias(f"d_{k}") for k in keys], F.col("v").alias("d"))
    on = reduce(Column.__and__, [F.col(k) == F.col(f"d_{k}") for k in keys])
    return lambda v: v.join(own, on).select(*keys, (F.col("v") / F.col("d")).alias("v"))


def gmres(keys: list[str], apply: Callable[[Vector], Vector], b: Vector, x: Vector | None = None, restart: int = 20, tolerance: float = 1e-10, most: int = 400, precondition: Callable[[Vector], Vector] | None = None) -> Solution:
    """x with apply(x) = b, preconditioned from the right, so that the residual is the system's own.

    Raises if ``most`` steps don't bring the residual to ``tolerance`` times the norm of b.
    """
    scratch = Scratch(b.sparkSession, "krylov")
    own = precondition or (lambda v: v)
    b = scratch.write(b.select(*keys, "v"))
    scale, steps = norm(b), 0
    x = scratch.write(b.where(F.lit(False)) if x is None else x.select(*keys, "v"))
    if scale == 0:
        return Solution(b.where(F.lit(False)), 0.0, 0)
    while True:
        r = scratch.write(total(keys, [(1.0, b), (-1.0, apply(x))]))
        beta = norm(r)
        if beta <= tolerance * scale:
            scratch.drop(r, b)
            return Solution(x, beta / scale, steps)
        if steps >= most:
            raise RuntimeError(f"the linear solver has a residual of {beta / scale:.3g} after {steps} steps")
        basis, rows = r.select(*keys, F.array(F.col("v") / beta).alias("q")), r
        h, y = np.zeros((restart + 1, restart)), np.zeros(0)
        for j in range(restart):
            steps += 1
            w = total(keys, [(1.0, apply(own(basis.select(*keys, F.col("q")[j].alias("v")))))])
            after = scratch.write(beside(keys, w, basis, j + 1))
            scratch.drop(rows)
            rows, v = after, F.col("v")
            for _ in range(2):  # twice, since one pass loses orthogonality
                h[: j + 1, j] += dots(rows, v, j + 1)[:-1]
                v = F.col("v") - weighted(h[: j + 1, j])
            h[j + 1, j] = np.sqrt(dots(rows, v, 0)[-1])
            right = np.zeros(j + 2)
            right[0] = beta
            y, *_ = np.linalg.lstsq(h[: j + 2, : j + 1], right, rcond=None)
            done = np.linalg.norm(h[: j + 2, : j + 1] @ y - right) <= tolerance * scale or h[j + 1, j] <= 1e-14 * beta
            if done or j + 1 == restart or steps >= most:
                break
            basis = rows.select(*keys, F.array_append("q", v / float(h[j + 1, j])).alias("q"))
        more = own(rows.select(*keys, weighted(y).alias("v")))
        after = scratch.write(total(keys, [(1.0, x), (1.0, more)]))
        scratch.drop(x, rows)
        x = after
