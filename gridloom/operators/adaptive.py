"""Adaptive solutions over tables: a growing, keyed set of elements, refined until it is stable.

The state is (i1..id, v0..), one row per element, also for elements whose coefficients
are 0. All of it stays in DataFrames; the driver sees a norm and counts of a round, and
the level tuples of new elements, of which there are as many as levels allow.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import index_1d, level_of
from gridloom.operators.adapt import COARSEN
from gridloom.operators.generators import cells_of, sparse_levels
from gridloom.operators.multiwave import compress, on_keys, prefixed, project
from gridloom.sources.scratch import Scratch


def coefficients(state: DataFrame) -> list[str]:
    return [c for c in state.columns if c.startswith("v")]


def norm(state: DataFrame, largest: bool) -> Column:
    """An element's norm is a formula of its row."""
    v = [F.col(c) for c in coefficients(state)]
    return F.greatest(*map(F.abs, v), F.lit(0.0)) if largest else F.sqrt(reduce(lambda a, b: a + b, [x * x for x in v]))


def total(state: DataFrame, largest: bool) -> float:
    own = norm(state, largest)
    found = state.agg(F.max(own) if largest else F.sqrt(F.sum(own * own))).first()[0]
    return float(found or 0.0)


def children(elements: DataFrame, d: int, limits: list[int]) -> DataFrame:
    """Distinct (i1..id) one level up in one dimension: index 1 from 0, else 2i and 2i + 1, up to the dimension's level."""
    keys = [f"i{k}" for k in range(1, d + 1)]

    def moved(k: int):
        return lambda x: F.struct(*[(x if j == k else F.col(f"i{j}")).alias(f"i{j}") for j in range(1, d + 1)])

    moves = []
    for k in range(1, d + 1):
        kids = F.when(F.col(f"i{k}") == 0, F.array(F.lit(1).cast("long"))).otherwise(F.array(2 * F.col(f"i{k}"), 2 * F.col(f"i{k}") + 1))
        kids = F.when(level_of(F.col(f"i{k}")) < limits[k - 1], kids).otherwise(F.array().cast("array<bigint>"))
        moves.append(F.transform(kids, moved(k)))
    return elements.select(F.explode(F.concat(*moves)).alias("e")).select(*[F.col(f"e.{c}").alias(c) for c in keys]).distinct()


def grown(state: DataFrame, d: int, limits: list[int], threshold: float, largest: bool = True) -> DataFrame:
    """The children that aren't there of elements whose norm is at least the threshold's part of the whole norm; none if that is 0."""
    bound = threshold * total(state, largest)
    if bound <= 0:
        return state.select(*[f"i{k}" for k in range(1, d + 1)]).limit(0)
    kids = children(state.where(norm(state, largest) >= bound), d, limits)
    return kids.join(prefixed(state, d, "h"), on_keys(d, "h"), "left_anti")


def coarsened(state: DataFrame, threshold: float, largest: bool = True) -> DataFrame:
    bound = COARSEN * threshold * total(state, largest)
    return state.where(norm(state, largest) > bound)


def with_zeros(members: DataFrame, state: DataFrame, d: int) -> DataFrame:
    """A row for each of the members; coefficients that ``state`` lacks are 0."""
    own = state.select(*[F.col(f"i{k}").alias(f"s{k}") for k in range(1, d + 1)], *coefficients(state))
    found = members.join(own, on_keys(d, "s"), "left")
    return found.select(*[f"i{k}" for k in range(1, d + 1)], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in coefficients(state)])


def sparse_elements(spark, d: int, limits: list[int], start: int) -> DataFrame:
    """(i1..id) of all elements whose levels keep their limits and have a sum of at most ``start``."""
    levels = sparse_levels(spark, limits, start)
    return cells_of(levels, d).select(*[index_1d(F.col(f"l{k}"), F.col(f"c{k}")).alias(f"i{k}") for k in range(1, d + 1)])


def _tuples(elements: DataFrame, d: int) -> list[tuple[int, ...]]:
    return sorted(tuple(r) for r in elements.select(*[level_of(F.col(f"i{k}")).alias(f"l{k}") for k in range(1, d + 1)]).distinct().collect())


def adapted_density(points: DataFrame, dims: list[str], degree: int, limits: list[int], start: int, threshold: float, weight: str | None = None, largest: bool = True) -> DataFrame:
    """Sums of the functions of an adapted set of elements over all points.

    The set begins with the sparse grid of level ``start``. Elements of large norm get
    their children, onto which the points are projected; this goes on until nothing
    is new. At last small elements are dropped. Coefficients of an orthonormal basis
    don't change with the set, so those that are there aren't projected again. The
    points are read once, and compressed to the finest cells that they meet.
    """
    spark, d = points.sparkSession, len(dims)
    scratch = Scratch(spark, "adapted")
    small = scratch.write(compress(points, dims, degree, max(limits), weight))
    new = scratch.write(sparse_elements(spark, d, limits, start))
    parts: list[DataFrame] = []
    while True:
        found = project(small, dims, degree, _tuples(new, d), "w", new)
        parts.append(scratch.write(with_zeros(new, found, d)))
        scratch.drop(new)
        state = reduce(DataFrame.unionByName, parts)
        new = scratch.write(grown(state, d, limits, threshold, largest))
        if new.isEmpty():
            break
    scratch.drop(small, new)
    return coarsened(state, threshold, largest)


def adapted_advance(state: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], d: int, limits: list[int], threshold: float, largest: bool = True) -> DataFrame:
    """One step of an adapted solution.

    Small elements are dropped. ``step`` takes the state and its elements (i1..id) and
    gives the new coefficients on them. If these want elements that aren't there, the
    state before the step gets them with zeros and the step is made again; the result
    is the last step's.
    """
    scratch = Scratch(state.sparkSession, "advance")
    state = scratch.write(coarsened(state, threshold, largest))
    while True:
        members = state.select(*[f"i{k}" for k in range(1, d + 1)])
        after = scratch.write(with_zeros(members, step(state, members), d))
        new = scratch.write(grown(after, d, limits, threshold, largest))
        if new.isEmpty():
            return after
        zeros = new.select("*", *[F.lit(0.0).alias(c) for c in coefficients(state)])
        wider = scratch.write(state.unionByName(zeros))
        scratch.drop(state, after, new)
        state = wider
