"""What a plot shows, as DataFrames: values at the nodes, slices through planes, centres of elements, moments and fields."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.dg.basis import nodes, realspace_matrix
from gridloom.dg.stepping import State

#: Values at the nodes of all dimensions at most; a dense result grows with the product of the dimensions.
MOST_VALUES = 1 << 24


def realspace(spark: SparkSession, state: State) -> DataFrame:
    """(x1..xd, v): the state's values at all nodes."""
    dims, dofs = state.problem.dims, state.elements.dofs(state.problem.degree)
    size = [d.degree << d.level for d in dims]
    if np.prod(size, dtype=float) > MOST_VALUES:
        raise ValueError("too many nodes for a dense result; lower the levels or take fewer dimensions")
    tensor = np.zeros(size)
    tensor[tuple(dofs.T)] = state.x
    for k, d in enumerate(dims):
        tensor = np.moveaxis(np.tensordot(realspace_matrix(d.degree, d.level, d.low, d.high, d.degree), tensor, axes=(1, k)), 0, k)
    axes = [nodes(d.degree, d.level, d.low, d.high, d.degree)[0].ravel() for d in dims]
    grid = np.meshgrid(*axes, indexing="ij")
    columns = {f"x{k + 1}": g.ravel() for k, g in enumerate(grid)}
    return spark.createDataFrame(pd.DataFrame({**columns, "v": tensor.ravel()}))


def plane(values: DataFrame, free: list[str], at: dict[str, float]) -> DataFrame:
    """The values on the plane nearest to ``at`` in the dimensions that are not free: a filter on coordinates."""
    for name, x in at.items():
        if name not in free:
            near = values.groupBy().agg(F.min(F.struct(F.abs(F.col(name) - x), F.col(name).alias("at")))["at"].alias("near"))
            values = values.join(F.broadcast(near), F.col(name) == F.col("near")).drop("near")
    return values.select(*free, "v")


def middle_planes(values: DataFrame, problem) -> dict[tuple[str, ...], DataFrame]:
    """For each pair of dimensions (or the only one) the values on the plane through the middle of the others."""
    names = [f"x{k + 1}" for k in range(len(problem.dims))]
    middle = {n: (d.low + d.high) / 2 for n, d in zip(names, problem.dims, strict=True)}
    return {free: plane(values, list(free), middle) for free in itertools.combinations(names, min(2, len(names)))}


def element_centres(spark: SparkSession, state: State) -> DataFrame:
    """(pos, x1..xd): the middle of each element's cell."""
    columns = {}
    for k, d in enumerate(state.problem.dims):
        level, cell = state.elements.levels[:, k], state.elements.cells[:, k]
        width = (d.high - d.low) / np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
        columns[f"x{k + 1}"] = d.low + (cell + 0.5) * width
    return spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(state.elements)), **columns}))


def view(spark: SparkSession, path: str, run: str, step: int | None = None) -> DataFrame:
    """A snapshot's values at the nodes, by default of the last step."""
    from gridloom.sources import snapshot

    return realspace(spark, snapshot.read(spark, path, run, step)[0])


def kinetic_fields(spark: SparkSession, moments, x: np.ndarray) -> DataFrame:
    """(x, n, u1.., theta, field, phi) at the nodes of the space dimension."""
    values = {k: f(moments.nodes) for k, f in moments.fields(x).items()}
    _, field, phi = moments.electric(x)
    return spark.createDataFrame(pd.DataFrame({"x": moments.nodes, **values, "field": field, "phi": phi}))
