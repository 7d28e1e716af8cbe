"""Connectivity of cells and elements as interval joins, and Kronecker products over it.

A cell of level l >= 1 covers an interval of the finest grid. Two cells are
connected if either level is at most 1, if their closed intervals meet, or if
they touch the two ends of the (periodic) dimension. Instead of comparing all
pairs, each cell is joined on the keys of what it can meet: per level a cell
meets the cells that cover it and its two edges, which is a bounded number of
keys, so the join is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import cell_of, index_1d, level_of, pow2


def cells_1d(spark: SparkSession, levels: int) -> DataFrame:
    """idx, l, c of all cells up to a level."""
    idx = F.col("id")
    return spark.range(1 << levels).select(idx.alias("idx"), level_of(idx).alias("l"), cell_of(idx).cast("int").alias("c"))


def edges_1d(spark: SparkSession, levels: int) -> DataFrame:
    """(row, col, kind) of connected cells; kind is diag, volume (nested supports) or edge."""
    cells = cells_1d(spark, levels)
    top = cells.where("l <= 1").select(F.col("idx").alias("row"))
    every = cells.select(F.col("idx").alias("col"))
    # cells of levels 0 and 1 are two rows: each meets all
    wide = top.join(F.broadcast(every)).unionByName(every.where("col > 1").select(F.col("col").alias("row")).join(F.broadcast(top.select(F.col("row").alias("col")))))
    # from a fine cell to each coarser level: the cells that its closed interval touches
    fine = cells.where("l > 1").withColumn("level", F.explode(F.sequence(F.lit(2), F.col("l"))))
    shift = F.col("l") - F.col("level")
    last = pow2(F.col("level") - 1) - 1
    scale = pow2(shift)
    first, end = F.floor(F.col("c") / scale), F.floor((F.col("c") + 1) / scale)
    low = F.when(F.col("c") % scale == 0, first - 1).otherwise(first)
    high = F.when((F.col("c") + 1) % scale == 0, end).otherwise(first)
    near = fine.withColumn("other", F.explode(F.array_distinct(F.transform(F.sequence(low, high), lambda k: F.pmod(k, last + 1)))))
    pairs = near.select(F.col("idx").alias("row"), index_1d(F.col("level"), F.col("other")).alias("col"))
    both = pairs.unionByName(pairs.select(F.col("col").alias("row"), F.col("row").alias("col"))).distinct()
    return wide.unionByName(both).withColumn("kind", kind("row", "col"))


def kind(row: str, col: str):
    """diag, volume or edge of a connected pair of one-dimensional indices."""
    a, b = F.least(row, col), F.greatest(row, col)
    nested = F.floor(cell_of(b) / pow2(level_of(b) - level_of(a))) == cell_of(a)
    return F.when(F.col(row) == F.col(col), "diag").when(nested | (a < 2), "volume").otherwise("edge")


def is_connected(l_a, c_a, l_b, c_b):
    """Whether two cells of a periodic dimension are connected, as an expression of their levels and cells."""
    low, high = F.least(l_a, l_b), F.greatest(l_a, l_b)
    coarse, fine = F.when(l_a <= l_b, c_a).otherwise(c_b), F.when(l_a <= l_b, c_b).otherwise(c_a)
    scale = pow2(high - low)
    start, end = coarse * scale, (coarse + 1) * scale
    last = pow2(high - 1)
    ends = ((start == 0) & (fine + 1 == last)) | ((end == last) & (fine == 0))
    return (low <= 1) | ((fine <= end) & (fine + 1 >= start)) | ends


def connected_elements(elements: DataFrame, edges: DataFrame, d: int) -> DataFrame:
    """Pairs (row, col) of element positions that are connected in every dimension.

    Each dimension's edges widen the row element's indices; an equi-join with the
    elements on all indices keeps the pairs that exist.
    """
    index = {f"i{i}": index_1d(F.col(f"l{i}"), F.col(f"c{i}")) for i in range(1, d + 1)}
    keyed = elements.withColumns(index).select("pos", *index)
    grown = keyed.withColumnRenamed("pos", "row")
    for i in range(1, d + 1):
        step = edges.select(F.col("row").alias("e_row"), F.col("col").alias(f"j{i}"))
        grown = grown.join(step, F.col(f"i{i}") == F.col("e_row")).drop("e_row")
    target = keyed.select(F.col("pos").alias("col"), *[F.col(f"i{i}").alias(f"t{i}") for i in range(1, d + 1)])
    on = [F.col(f"j{i}") == F.col(f"t{i}") for i in range(1, d + 1)]
    return grown.join(target, on).select("row", "col")


def kron_apply(state: DataFrame, operators: list[DataFrame], d: int) -> DataFrame:
    """y = (A_1 x ... x A_d) x over a state (i1..id, v), one dimension after the other.

    Each step is an equi-join on one index and a sum, so the work is that of the
    factors and never that of all pairs of elements.
    """
    for i, op in enumerate(operators, 1):
        factor = op.select(F.col("row").alias("o_row"), F.col("col").alias("o_col"), F.col("v").alias("o_v"))
        joined = state.join(factor, F.col(f"i{i}") == F.col("o_col"))
        keep = [f"i{k}" for k in range(1, d + 1) if k != i]
        state = joined.groupBy(*keep, F.col("o_row").alias(f"i{i}")).agg(F.sum(F.col("v") * F.col("o_v")).alias("v"))
    return state


def _direction(state: DataFrame, op: DataFrame, k: int, d: int, members: DataFrame | None) -> DataFrame:
    """``op`` applied in dimension k; with ``members`` only rows of these are made."""
    factor = op.select(F.col("row").alias("o_row"), F.col("col").alias("o_col"), F.col("v").alias("o_v"))
    joined = state.join(factor, F.col(f"i{k}") == F.col("o_col"))
    keys = {f"i{j}": F.col("o_row") if j == k else F.col(f"i{j}") for j in range(1, d + 1)}
    made = joined.select(*[c.alias(n) for n, c in keys.items()], (F.col("v") * F.col("o_v")).alias("v"))
    if members is not None:
        own = members.select(*[F.col(f"i{j}").alias(f"m{j}") for j in range(1, d + 1)])
        made = made.join(own, [F.col(f"i{j}") == F.col(f"m{j}") for j in range(1, d + 1)], "left_semi")
    return made.groupBy(*keys).agg(F.sum("v").alias("v"))


def split_upper_lower(op: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries towards the same or a coarser level, and those towards a finer one."""
    coarser = level_of(F.col("row")) <= level_of(F.col("col"))
    return op.where(coarser), op.where(~coarser)


def directional_apply(state: DataFrame, operators: list[DataFrame], d: int, members: DataFrame) -> DataFrame:
    """(A_1 x ... x A_d) x on ``members``, in unidirectional passes that never leave the set.

    ``members`` (i1..id) must hold, with an element, all elements of the same or coarser
    levels in each dimension, and ``state`` must be on it. In each dimension but the
    first the operator is split: what leads to the same or a coarser level ("upper") stays
    in the set and is applied first, what leads to a finer one ("lower") is applied
    last and cut to the set, where nothing that is cut could lead back. So each of the
    2**(d-1) orders is exact, and its intermediates are at most as large as the set;
    applying whole operators one after the other lets them grow to the tensor grid.
    """
    parts = {k: split_upper_lower(op) for k, op in enumerate(operators, 1)}
    found: list[DataFrame] = []

    def order(k: int, x: DataFrame, later: list[int]) -> None:
        if k == 1:
            x = _direction(x, operators[0], 1, d, members)
            for j in later:
                x = _direction(x, parts[j][1], j, d, members)
            found.append(x)
            return
        order(k - 1, _direction(x, parts[k][0], k, d, None), later)
        order(k - 1, x, [k, *later])

    order(d, state.select(*[f"i{j}" for j in range(1, d + 1)], "v"), [])
    both = found[0]
    for x in found[1:]:
        both = both.unionByName(x)
    return both.groupBy(*[f"i{j}" for j in range(1, d + 1)]).agg(F.sum("v").alias("v"))


def ancestor_completion(spark: SparkSession, indices: DataFrame, d: int, levels: int) -> DataFrame:
    """Indices to be added so that with an index all its ancestors in each dimension are there.

    The ancestors of an index are the products of its dimensions' own ancestors
    (itself and its parents up to 0), so one explode per dimension finds the closure.
    """
    grown = indices
    for i in range(1, d + 1):
        chain = F.expr(f"array_distinct(concat(array(0L), transform(sequence(0, {levels}), k -> shiftright(i{i}, k))))")
        grown = grown.withColumn(f"i{i}", F.explode(chain))
    return grown.distinct().join(indices, [f"i{i}" for i in range(1, d + 1)], "left_anti")
