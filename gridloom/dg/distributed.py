"""Time steps as DataFrame jobs: neither state nor elements are ever on the driver.

The state is in long form, (i1..id, v), with one-dimensional rows as keys. What is
small is built on the driver: the one-dimensional matrices and vectors of each
dimension, whose size is that of one dimension. An operator is applied one
dimension after the other (an equi-join and a sum each), the result is cut to the
element set by a semi-join, and sums of vectors are one aggregation. Each step's
state is written to the shared folder, so that the plan of a step does not grow with
their number; what a step needs on the way is deleted when it is done.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.dg.basis import project
from gridloom.dg.operators import boundary_parts, chain, mass_matrix
from gridloom.dg.spec import Problem
from gridloom.functions.scalar import index_1d
from gridloom.operators import krylov
from gridloom.operators.connect import kron_apply
from gridloom.operators.generators import element_table, sparse_levels
from gridloom.sources.scratch import Scratch


def keys(problem: Problem) -> list[str]:
    return [f"i{k}" for k in range(1, len(problem.dims) + 1)]


def dof_table(spark: SparkSession, problem: Problem) -> DataFrame:
    """(i1..id): the one-dimensional rows of all coefficients of the sparse grid."""
    d, limits = len(problem.dims), [x.level for x in problem.dims]
    cells = element_table(sparse_levels(spark, limits, max(limits)), d, max(limits) + 2)
    digit = F.sequence(F.lit(0), F.lit(problem.degree - 1))
    out = cells.select(*[index_1d(F.col(f"l{k}"), F.col(f"c{k}")).cast("long").alias(f"e{k}") for k in range(1, d + 1)])
    for k in range(1, d + 1):
        out = out.withColumn(f"p{k}", F.explode(digit))
    return out.select(*[(F.col(f"e{k}") * problem.degree + F.col(f"p{k}")).alias(f"i{k}") for k in range(1, d + 1)])


def matrix_rows(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """(row, col, v) of the entries that are not zero."""
    row, col = np.nonzero(matrix)
    return spark.createDataFrame(pd.DataFrame({"row": row, "col": col, "v": matrix[row, col]}), "row long, col long, v double")


def product_rows(spark: SparkSession, problem: Problem, dofs: DataFrame, vectors: list[np.ndarray], factor: float = 1.0) -> DataFrame:
    """(i1..id, v) of a product of one-dimensional vectors: a join with one small table per dimension."""
    out, value = dofs, F.lit(float(factor))
    for k, v in enumerate(vectors, 1):
        small = spark.createDataFrame(pd.DataFrame({f"s{k}": np.arange(len(v)), f"f{k}": v}), f"s{k} long, f{k} double")
        out = out.join(F.broadcast(small), F.col(f"i{k}") == F.col(f"s{k}")).drop(f"s{k}")
        value = value * F.col(f"f{k}")
    return out.withColumn("v", value).select(*keys(problem), "v")


def separable_rows(spark: SparkSession, problem: Problem, dofs: DataFrame, functions, t: float, factor: float = 1.0) -> DataFrame:
    """(i1..id, v) of a product of one-dimensional functions."""
    vectors = []
    for dim, f in zip(problem.dims, functions, strict=True):
        v = project(lambda x, f=f: f(x, t), dim.degree, dim.level, dim.low, dim.high, dim.jacobian)
        vectors.append(v if dim.jacobian is None else np.linalg.solve(mass_matrix(dim), v))
    return product_rows(spark, problem, dofs, vectors, factor)


def total(problem: Problem, parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """Weighted sum of vectors, combined before the shuffle."""
    scaled = [p.select(*keys(problem), (F.col("v") * float(w)).alias("v")) for w, p in parts]
    every = scaled[0]
    for p in scaled[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys(problem)).agg(F.sum("v").alias("v"))


class Steps:
    """Operators, element set, sources and boundaries of a problem, for steps of a state in long form."""

    def __init__(self, spark: SparkSession, problem: Problem):
        self.spark, self.problem = spark, problem
        self.scratch = Scratch(spark, "steps")
        self.dofs = self.scratch.write(dof_table(spark, problem))
        self.at(0.0)

    def at(self, t: float) -> None:
        """Builds the one-dimensional matrices for a time, unless those that are there hold for it too."""
        if not hasattr(self, "terms") or self.problem.depends_on_time() and t != self.time:
            self.time = t
            self.terms = [[matrix_rows(self.spark, chain(c, d, t)) for c, d in zip(x.chains, self.problem.dims, strict=True)] for x in self.problem.terms]

    def initial(self) -> DataFrame:
        p = self.problem
        factor = p.exact_time(0.0) if p.exact_time is not None else 1.0
        return self.scratch.write(total(p, [(factor, separable_rows(self.spark, p, self.dofs, f, 0.0)) for f in p.initial]))

    def apply(self, state: DataFrame) -> DataFrame:
        d = len(self.problem.dims)
        out = [(1.0, kron_apply(state, factors, d).select(*keys(self.problem), "v")) for factors in self.terms]
        return total(self.problem, out).join(self.dofs, keys(self.problem), "left_semi")

    def forcing(self, t: float, factor: float = 1.0) -> list[tuple[float, DataFrame]]:
        """Sources and boundary contributions at a time, times a factor."""
        p = self.problem
        sources = [(factor * s.time(t), separable_rows(self.spark, p, self.dofs, s.functions, t)) for s in p.sources]
        return sources + [(factor * w, product_rows(self.spark, p, self.dofs, v)) for w, v in boundary_parts(p, t)]

    def slope(self, state: DataFrame, t: float) -> DataFrame:
        return total(self.problem, [(1.0, self.apply(state)), *self.forcing(t)])

    def explicit(self, state: DataFrame, t: float, dt: float) -> DataFrame:
        """Third-order Runge-Kutta, with the matrices of the step's start."""
        p = self.problem
        self.at(t)
        k1 = self.scratch.write(self.slope(state, t))
        k2 = self.scratch.write(self.slope(total(p, [(1.0, state), (0.5 * dt, k1)]), t + 0.5 * dt))
        k3 = self.slope(total(p, [(1.0, state), (-dt, k1), (2 * dt, k2)]), t + dt)
        after = self.scratch.write(total(p, [(1.0, state), (dt / 6, k1), (2 * dt / 3, k2), (dt / 6, k3)]))
        self.scratch.drop(k1, k2)
        return after

    def implicit(self, state: DataFrame, t: float, dt: float, tolerance: float = 1e-10, most: int = 400) -> DataFrame:
        """Backward Euler by restarted GMRES without a matrix: basis vectors stay in the folder, only their inner products come here."""
        p = self.problem
        self.at(t)
        b = total(p, [(1.0, state), *self.forcing(t + dt, dt)])
        return krylov.gmres(keys(p), lambda v: total(p, [(1.0, v), (-dt, self.apply(v))]), b, state, tolerance=tolerance, most=most).x


def run(spark: SparkSession, problem: Problem, steps: int, cfl: float = 0.01, dt: float | None = None, implicit: bool = False):
    """(step, time after it, state in long form) of each step."""
    h, jobs = problem.step(cfl, dt), Steps(spark, problem)
    state = jobs.initial()
    for i in range(steps):
        state = (jobs.implicit if implicit else jobs.explicit)(state, i * h, h)
        yield i, (i + 1) * h, state
