"""Set-returning operators: level sets, cells, element tables, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import element_id, index_1d, pow2
from gridloom.operators.ordered import number


def ranges(spark: SparkSession, limits: list[int], prefix: str = "l") -> DataFrame:
    """All tuples 0 <= prefix_i <= limits[i]; the bounds are parameters, not data."""
    first = spark.range(limits[0] + 1).select(F.col("id").cast("int").alias(f"{prefix}1"))
    for i, limit in enumerate(limits[1:], 2):
        first = first.withColumn(f"{prefix}{i}", F.explode(F.sequence(F.lit(0), F.lit(limit))))
    return first


def level_sum(d: int, prefix: str = "l") -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"{prefix}{i}") for i in range(1, d + 1)])


def sparse_levels(spark: SparkSession, levels: list[int], limit: int) -> DataFrame:
    """Level tuples with each level in its bound and their sum at most ``limit``."""
    return ranges(spark, [min(v, limit) for v in levels]).where(level_sum(len(levels)) <= limit)


def mixed_levels(spark: SparkSession, levels: list[int], first: int, limits: tuple[int, int]) -> DataFrame:
    """Level tuples whose first ``first`` levels and whose others keep a sum each."""
    one = reduce(lambda a, b: a + b, [F.col(f"l{i}") for i in range(1, first + 1)])
    two = reduce(lambda a, b: a + b, [F.col(f"l{i}") for i in range(first + 1, len(levels) + 1)])
    return ranges(spark, levels).where((one <= limits[0]) & (two <= limits[1]))


def constrained_lists(spark: SparkSession, lists: list[list[int]], max_sum: int, max_value: int) -> DataFrame:
    """Positions into value lists such that the values' sum and largest keep their bounds."""
    frame = ranges(spark, [len(v) - 1 for v in lists], "p")
    values = [F.element_at(F.array(*[F.lit(x) for x in v]), F.col(f"p{i}") + 1) for i, v in enumerate(lists, 1)]
    total = reduce(lambda a, b: a + b, values)
    largest = F.greatest(*values) if len(values) > 1 else values[0]
    return frame.withColumns({"total": total, "largest": largest}).where((F.col("total") <= max_sum) & (F.col("largest") <= max_value))


def lower_closure(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The least lower-complete set with all rows of small integers: with a row, all rows that are nowhere larger and nowhere negative."""
    for c in columns:
        frame = frame.distinct().withColumn(c, F.explode(F.sequence(F.lit(0), F.col(c).cast("int"))))
    return frame.select(*columns).distinct()


def highest_first(frame: DataFrame, d: int) -> DataFrame:
    """With ``pos``: highest level sum first, then by the last dimension's level, ..., the first's."""
    order = [F.desc("level_sum"), *[F.col(f"l{i}") for i in range(d, 0, -1)]]
    return number(frame.withColumn("level_sum", level_sum(d)), order, "pos").withColumn("pos", F.col("pos").cast("int"))


def cells_of(frame: DataFrame, d: int) -> DataFrame:
    """Each level tuple's cells c1..cd; a level of 0 or 1 has one cell, level l has 2**(l-1)."""
    for i in range(1, d + 1):
        last = pow2(F.greatest(F.col(f"l{i}") - 1, F.lit(0))) - 1
        frame = frame.withColumn(f"c{i}", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return frame


def element_table(levels: DataFrame, d: int, max_level: int) -> DataFrame:
    """pos, id, l1..ld, c1..cd in the order of the state vector: highest level sum first, cells with the first dimension fastest."""
    return numbered_elements(cells_of(levels.select(*[f"l{i}" for i in range(1, d + 1)]), d), d, max_level)


def numbered_elements(cells: DataFrame, d: int, max_level: int) -> DataFrame:
    """The element table of distinct (l1..ld, c1..cd)."""
    index = [index_1d(F.col(f"l{i}"), F.col(f"c{i}")) for i in range(1, d + 1)]
    order = [F.desc(level_sum(d)), *[F.col(f"l{i}") for i in range(d, 0, -1)], *[F.col(f"c{i}") for i in range(d, 0, -1)]]
    numbered = number(cells.withColumn("id", element_id(index, max_level)), order, "pos")
    return numbered.select("pos", "id", *[f"l{i}" for i in range(1, d + 1)], *[f"c{i}" for i in range(1, d + 1)])


def children(elements: DataFrame, d: int, max_levels: list[int]) -> DataFrame:
    """Child elements in each dimension: one level up, cells 2c and (from level 1 on) 2c + 1."""
    found = None
    for i in range(1, d + 1):
        room = elements.where(F.col(f"l{i}") < max_levels[i - 1]).withColumn("dim", F.lit(i))
        kids = F.when(F.col(f"l{i}") == 0, F.array(F.lit(0))).otherwise(F.array(2 * F.col(f"c{i}"), 2 * F.col(f"c{i}") + 1))
        room = room.withColumn("kid", F.explode(kids)).withColumn(f"l{i}", F.col(f"l{i}") + 1).withColumn(f"c{i}", F.col("kid").cast("int")).drop("kid")
        found = room if found is None else found.unionByName(room)
    return found


def dof_expansion(elements: DataFrame, degree: int, d: int) -> DataFrame:
    """degree**d rows per element: digits p1..pd (last fastest), indices i1..id and the running number of the state vector."""
    total = degree**d
    grown = elements.withColumn("dof", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    for i in range(1, d + 1):
        digit = F.floor(F.col("dof") / degree ** (d - i)) % degree
        grown = grown.withColumn(f"i{i}", index_1d(F.col(f"l{i}"), F.col(f"c{i}")) * degree + digit.cast("long"))
    return grown.withColumn("at", F.col("pos") * total + F.col("dof"))


def linspace(spark: SparkSession, low: float, high: float, n: int = 100) -> DataFrame:
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(low) + F.col("id") * F.lit(step)).alias("v"))


def eye(spark: SparkSession, rows: int, columns: int | None = None) -> DataFrame:
    """Dense identity (row, col, v)."""
    frame = spark.range(rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((columns or rows) - 1).cast("long"))).alias("col"))
    return frame.withColumn("v", F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0))


def meshgrid(spark: SparkSession, start: int, length: int) -> DataFrame:
    """Square of integers whose rows all run from ``start``."""
    return eye(spark, length).select("row", "col", (F.col("col") + start).alias("v"))


def iota(spark: SparkSession, first: int, last: int, step: int) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("i", "v"))


def realspace_nodes(spark: SparkSession, roots: list[float], level: int, low: float, high: float) -> DataFrame:
    """Quadrature nodes of every cell of a dimension."""
    h = (high - low) / (1 << level)
    cells = spark.range(1 << level).select(F.col("id").alias("cell"), F.posexplode(F.array(*[F.lit(float(r)) for r in roots])).alias("q", "root"))
    return cells.withColumn("x", (0.5 * (F.col("root") + 1) + F.col("cell")) * h + low)


def element_centres(elements: DataFrame, d: int, domain: list[tuple[float, float]]) -> DataFrame:
    """Centre x1..xd of each element's support."""
    for i, (low, high) in enumerate(domain, 1):
        level = F.greatest(F.col(f"l{i}") - 1, F.lit(0))
        elements = elements.withColumn(f"x{i}", (F.col(f"c{i}") + 0.5) / pow2(level) * (high - low) + low)
    return elements
