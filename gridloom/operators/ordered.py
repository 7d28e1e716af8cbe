"""Order-dependent operators: prefix sums, first occurrences, runs, neighbours, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.sources.scratch import Scratch


def _dealt(frame: DataFrame, parts: int, *order) -> DataFrame:
    """The rows in ranges, with ``_part``; written, so that whatever is computed from the parts sees the same ones."""
    return Scratch(frame.sparkSession, "ranges").write(frame.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def number(frame: DataFrame, order: list, name: str, parts: int = 16) -> DataFrame:
    """Rows numbered from 0 in a unique order; each range is numbered by itself, behind the counts of the ranges before it."""
    dealt = _dealt(frame, parts, *order)
    counts = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)).cast("long") - 1
    return dealt.withColumn(name, own).join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_p", "_before")


def exclusive_sum(frame: DataFrame, order: str, value: str, name: str, parts: int = 64) -> DataFrame:
    """Sum of ``value`` over all rows before, in the order of a unique column.

    Rows are range-partitioned; each part is summed by itself and the parts' sums
    are summed over one small row per part, so no task holds all rows.
    """
    dealt = _dealt(frame, parts, order)
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("_part").alias("_p"), before.alias("_before"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = dealt.withColumn("_inside", inside).join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_p", "_before", "_inside")


def first_occurrences(frame: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in order, without a sort: a minimum that is combined before the shuffle."""
    columns = [c for c in frame.columns if c not in (key, order)]
    least = frame.groupBy(key).agg(F.min(F.struct(order, *columns)).alias("_first"))
    return least.select(key, *[F.col(f"_first.{c}").alias(c) for c in (order, *columns)])


def islands(kept: DataFrame, key: str, order: str) -> DataFrame:
    """Maximal runs of consecutive integers: (key, first, last, new_first); new_first numbers what is kept."""
    number = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    numbered = kept.withColumn("_n", number).withColumn("_island", F.col(order) - F.col("_n"))
    return numbered.groupBy(key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("_n").alias("new_first")).drop("_island")


def overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of ranges (lo, hi) that overlap, clipped: an equi-join on the blocks of ``width`` that a range touches.

    A pair that shares several blocks is kept in the first of them only.
    """
    block = lambda f, p: f.select(*[F.col(c).alias(f"{p}_{c}") for c in f.columns]).withColumn(f"{p}_block", F.explode(F.sequence(F.floor(F.col(f"{p}_lo") / width), F.floor(F.col(f"{p}_hi") / width))))
    both = block(left, "a").join(block(right, "b"), (F.col("a_block") == F.col("b_block")) & (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi")))
    both = both.where(F.col("a_block") == F.floor(F.greatest("a_lo", "b_lo") / width)).drop("a_block", "b_block")
    return both.withColumns({"lo": F.greatest("a_lo", "b_lo"), "hi": F.least("a_hi", "b_hi")})


def nearest_sample(points: DataFrame, samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each point's value at the nearest sample of its key; of two equally near the last sample counts.

    One union and two windows (last sample before, first after) take the place of
    a join of all points with all samples.
    """
    p = points.select(key, F.col("x"), F.lit(None).cast("double").alias("s_at"), F.lit(None).cast("double").alias("s_value"), F.lit(1).alias("point"))
    s = samples.select(key, F.col(at).alias("x"), F.col(at).alias("s_at"), F.col(value).alias("s_value"), F.lit(0).alias("point"))
    every = p.unionByName(s)
    back = W.partitionBy(key).orderBy("x", "point").rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(key).orderBy("x", "point").rowsBetween(W.currentRow, W.unboundedFollowing)
    sample = F.struct("s_at", "s_value")
    seen = every.withColumns({"_b": F.last(F.when(F.col("point") == 0, sample), True).over(back), "_a": F.first(F.when(F.col("point") == 0, sample), True).over(ahead)})
    left, right = F.col("x") - F.col("_b.s_at"), F.col("_a.s_at") - F.col("x")
    pick = F.when(F.col("_a").isNull() | (left < right), F.col("_b.s_value")).otherwise(F.col("_a.s_value"))
    return seen.where("point = 1").select(key, "x", pick.alias("v"))
