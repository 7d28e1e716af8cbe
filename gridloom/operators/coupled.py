"""Several fields in one keyed state, stepped together.

The state is (field, k, v). All linear terms, within a field and between fields, are one table of blocks
(target, row, source, col, v), so that a slope is one equi-join on source and col and one
sum, whatever the number of fields. Each field has indices of its own from 0 on; a
term between fields of different size is a block of that shape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.krylov import total
from gridloom.sources.scratch import Scratch

KEYS = ["field", "k"]


def state_of(fields: dict[str, DataFrame]) -> DataFrame:
    """The tables (k, v) of the fields as one state."""
    return reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("field"), F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v")) for name, t in fields.items()])


def block(target: str, source: str, matrix: DataFrame, factor: float = 1.0) -> DataFrame:
    """A matrix (row, col, v) that takes a field's coefficients to another field, or to the same."""
    return matrix.select(F.lit(target).alias("target"), "row", F.lit(source).alias("source"), "col", (F.col("v") * float(factor)).alias("v"))


def slope(state: DataFrame, terms: DataFrame) -> DataFrame:
    own = state.select(F.col("field").alias("s_field"), F.col("k").alias("s_k"), F.col("v").alias("s_v"))
    joined = terms.join(own, (F.col("source") == F.col("s_field")) & (F.col("col") == F.col("s_k")))
    return joined.groupBy(F.col("target").alias("field"), F.col("row").alias("k")).agg(F.sum(F.col("v") * F.col("s_v")).alias("v"))


def advanced(state: DataFrame, terms: DataFrame, dt: float, steps: int = 1) -> DataFrame:
    """The state after explicit steps of third order."""
    scratch = Scratch(state.sparkSession, "fields")
    terms, state = scratch.write(terms), scratch.write(state)
    for _ in range(steps):
        one = scratch.write(slope(state, terms))
        two = scratch.write(slope(total(KEYS, [(1.0, state), (0.5 * dt, one)]), terms))
        three = slope(total(KEYS, [(1.0, state), (-dt, one), (2 * dt, two)]), terms)
        after = scratch.write(total(KEYS, [(1.0, state), (dt / 6, one), (2 * dt / 3, two), (dt / 6, three)]))
        scratch.drop(one, two, state)
        state = after
    return state
