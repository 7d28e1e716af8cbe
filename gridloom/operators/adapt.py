"""Refinement and coarsening of keyed segments (key, dof, v) by their norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ordered import number

#: Coarsening keeps what has more than this part of the refinement's bound.
COARSEN = 0.1


def segment_norms(state: DataFrame, largest: bool) -> DataFrame:
    norm = F.max(F.abs("v")) if largest else F.sqrt(F.sum(F.col("v") * F.col("v")))
    return state.groupBy("key").agg(norm.alias("norm"))


def global_norm(norms: DataFrame, largest: bool) -> DataFrame:
    total = F.max("norm") if largest else F.sqrt(F.sum(F.col("norm") * F.col("norm")))
    return norms.agg(total.alias("total"))


def _split(state: DataFrame, test: Column, largest: bool) -> DataFrame:
    norms = segment_norms(state, largest)
    return norms.join(F.broadcast(global_norm(norms, largest))).where(test)


def to_refine(state: DataFrame, threshold: float, largest: bool = True) -> DataFrame:
    """Keys with norm >= threshold times the global norm; none if that is not positive."""
    bound = F.col("total") * threshold
    return _split(state, (bound > 0) & (F.col("norm") >= bound), largest)


def to_drop(state: DataFrame, threshold: float, largest: bool = True) -> DataFrame:
    return _split(state, F.col("norm") <= F.col("total") * (threshold * COARSEN), largest)


def coarsen(state: DataFrame, threshold: float, largest: bool = True) -> DataFrame:
    gone = to_drop(state, threshold, largest).select(F.col("key").alias("g_key"))
    return state.join(gone, F.col("key") == F.col("g_key"), "left_anti")


def refine(state: DataFrame, threshold: float, kids: Column, dofs: int, largest: bool = True) -> DataFrame:
    """State with zero segments for the new keys among the array ``kids`` of the keys to be refined."""
    new = to_refine(state, threshold, largest).select(F.explode(kids).alias("key")).distinct()
    known = state.select(F.col("key").alias("k_key")).distinct()
    new = new.join(known, F.col("key") == F.col("k_key"), "left_anti")
    zeros = new.select("key", F.explode(F.sequence(F.lit(0), F.lit(dofs - 1))).alias("dof"), F.lit(0.0).alias("v"))
    return state.select("key", "dof", "v").unionByName(zeros)


def renumbered(state: DataFrame) -> DataFrame:
    """With the new position of each key."""
    at = number(state.select(F.col("key").alias("n_key")).distinct(), ["n_key"], "pos").withColumn("pos", F.col("pos").cast("int"))
    return state.join(at, F.col("key") == F.col("n_key")).drop("n_key")
